"""Exact top-k search by tiled products.

Vectors are packed into shards in the scan, the stated queries into blocks of about ``BLOCK`` rows. Every block
meets every shard once, as one matrix product; of a tile only the k best per query are kept, merged over the tiles
of a task, and the lists of tasks are merged as a tree. Blocks are dealt into groups and shards over salts; a group meets
the shards of a salt in one place (see ``grid``). Both sides are shuffled to it, so that neither is ever whole anywhere,
the driver included, and no pair of vectors becomes a row.

Components are floor(256 x) as double; products are exact: in floating point while no sum can pass 2**53,
else in Python integers.

Defined results: null vectors and vectors with null or non-finite components (also after the factor 256) take no
part, nor do rows without an id; vectors of another length than a query's are no candidates for it; rows with the
query's id are not its candidates; of identical repeated query rows one is searched, repeated candidates count each;
equal scores go to the smaller id; scores beyond a long are held at its ends. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonset.session import saved_once

from .common import table

BLOCK, SHARD, FANOUT, GROUP = 1024, 2048, 8, 8
_NONE = np.iinfo(np.int64).min
_TOP = np.iinfo(np.int64).max


def _packed(matrix: np.ndarray) -> tuple[str, bytes]:
    """The smallest type that holds the integers exactly, and their bytes."""
    most = float(np.abs(matrix).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, matrix.astype(kind).tobytes()


def _valid(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) for each vector length in a batch."""
    by_size: dict[int, tuple[list, list]] = {}
    for i, vector in enumerate(batch.column(column)):
        if not vector.is_valid:
            continue
        values = vector.values
        if values.null_count:
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(256.0 * values.to_numpy(zero_copy_only=False).astype(np.float64))
        if np.isfinite(x).all():
            at, rows = by_size.setdefault(len(x), ([], []))
            at.append(i)
            rows.append(x)
    for size, (at, rows) in by_size.items():
        yield np.array(at), np.array(rows).reshape(len(rows), size)


_SHARDS = "dim int, shard long, ids binary, kind string, data binary"
_ROW = [("ids", pa.binary()), ("kind", pa.string()), ("data", pa.binary())]


def _pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), *_ROW])
    count = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for at, matrix in _valid(batch, 1):
            for start in range(0, len(at), SHARD):
                kind, data = _packed(matrix[start : start + SHARD])
                row = {"dim": matrix.shape[1], "shard": count, "ids": ids[at[start : start + SHARD]].astype("<i8").tobytes(), "kind": kind, "data": data}
                count += 1
                yield pa.RecordBatch.from_pylist([row], schema=schema)


def _pack_block(table_: pa.Table) -> pa.Table:
    schema = pa.schema([("block", pa.int32()), ("dim", pa.int32()), ("qkeys", pa.binary()), *_ROW])
    rows = []
    for batch in table_.combine_chunks().to_batches():
        ids, keys = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for at, matrix in _valid(batch, 3):
            kind, data = _packed(matrix)
            rows.append(
                {"block": batch.column(0)[0].as_py(), "dim": matrix.shape[1], "qkeys": keys[at].astype("<i8").tobytes(), "ids": ids[at].astype("<i8").tobytes(), "kind": kind, "data": data}
            )
    return pa.Table.from_pylist(rows, schema=schema)


def _matrix(kind: str, data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(rows, -1).astype(np.float64)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of integral vectors, held inside a long."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if largest < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    found = exact(queries) @ exact(vectors).T
    return np.array([[max(-_TOP, min(_TOP, int(x))) for x in row] for row in found], np.int64).reshape(len(queries), len(vectors))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best (score, id), larger scores and then smaller ids first; ``_NONE`` marks no entry.

    ``ids`` is one row for all or one per row.
    """
    rows, n = scores.shape
    if n > k:
        bound = np.partition(scores, n - k, axis=1)[:, n - k]
        row, col = np.nonzero(scores >= bound[:, None])
    else:
        row, col = np.nonzero(np.ones_like(scores, bool))
    value, name = scores[row, col], ids[col] if ids.ndim == 1 else ids[row, col]
    order = np.lexsort((name, ~value, row))  # ~value falls as value rises, without overflow
    row, value, name = row[order], value[order], name[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    held = place < k
    out_s, out_i = np.full((rows, k), _NONE), np.full((rows, k), _TOP)
    out_s[row[held], place[held]], out_i[row[held], place[held]] = value[held], name[held]
    return out_s, out_i


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[tuple[int, int], list] = {}
        task = TaskContext.get().partitionId()

        def listed():
            rows = []
            for ids, keys, scores, names in tops.values():
                for q, key, s, n in zip(ids.tolist(), keys.tolist(), scores.tolist(), names.tolist()):
                    top = [{"less": -x, "id": y} for x, y in zip(s, n) if x != _NONE]
                    if top:
                        rows.append({"query_id": q, "qkey": key, "node": task, "top": top})
            return pa.RecordBatch.from_pylist(rows, schema=_TOPS)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_ids, v_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                scores = products(_matrix(row["q_kind"], row["q_data"], len(q_ids)), _matrix(row["kind"], row["data"], len(v_ids)))
                scores[q_ids[:, None] == v_ids[None, :]] = _NONE
                found = best_of(scores, v_ids, k)
                at = (row["block"], row["dim"])
                if at in tops:
                    _, _, s, n = tops[at]
                    found = best_of(np.hstack([s, found[0]]), np.hstack([n, found[1]]), k)
                elif len(tops) >= 64:
                    yield listed()
                    tops.clear()
                tops[at] = [q_ids, np.frombuffer(row["qkeys"], "<i8"), *found]
        if tops:
            yield listed()

    return run


_TOPS = pa.schema(
    [("query_id", pa.int64()), ("qkey", pa.int64()), ("node", pa.int32()), ("top", pa.list_(pa.struct([("less", pa.int64()), ("id", pa.int64())])))]
)


def grid(tasks: int, queries: int, vectors: int) -> tuple[int, int]:
    """Into how many groups the blocks and over how many salts the shards are dealt.

    Every query is copied once per salt and every vector once per group; with a place for each task these copies are fewest at this
    number of salts. A group has ``GROUP`` blocks at most, which a task holds at a time.
    """
    blocks = max(1, math.ceil(queries / BLOCK))
    salts = max(1, min(4 * tasks, round(math.sqrt(tasks * vectors / max(1, queries)))))
    return min(blocks, max(math.ceil(tasks / salts), math.ceil(blocks / GROUP))), salts


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: the k best candidates of every query row."""
    spark = vectors.sparkSession
    only = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    asked = only(queries).dropDuplicates(["id", "v"])
    tasks, n_queries = int(spark.conf.get("spark.sql.shuffle.partitions")), asked.count()
    n_blocks = max(1, math.ceil(n_queries / BLOCK))
    groups, salts = grid(tasks, n_queries, vectors.count())
    blocks = (
        asked.select(F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).cast("int").alias("block"), "id", F.xxhash64("v").alias("qkey"), "v")
        .groupBy("block")
        .applyInArrow(_pack_block, "block int, dim int, qkeys binary, ids binary, kind string, data binary")
        .select(F.pmod("block", F.lit(groups)).alias("grp"), "block", "dim", "qkeys", *[F.col(c).alias(f"q_{c}") for c in ("ids", "kind", "data")])
    )
    # Spark takes the copied blocks for as small as they are once; without the hint the driver would gather all copies to broadcast them.
    blocks = saved_once(blocks, "queries").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    shards = only(vectors).mapInArrow(_pack_shards, _SHARDS)
    shards = shards.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(salts)).cast("int")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    tiles = shards.join(blocks, ["grp", "salt", "dim"]).select("block", "dim", "qkeys", "q_ids", "q_kind", "q_data", "ids", "kind", "data")
    tops = tiles.mapInArrow(_search(k), "query_id long, qkey long, node int, top array<struct<less:bigint,id:bigint>>")
    reach = tasks * FANOUT
    while reach > 1:
        tops = tops.groupBy("query_id", "qkey", F.floor(F.col("node") / FANOUT).cast("int").alias("node")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
        reach = math.ceil(reach / FANOUT)
    tops = tops.groupBy("query_id", "qkey").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    ranked = tops.select("query_id", F.posexplode("top").alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
