"""Near duplicates among vectors by a pivot-permutation index.

Reference points (pivots) are about the square root of the number of different vectors; a vector is described by its
``PERMUTATION`` nearest pivots in order. It is entered in the inverted lists of the first ``LISTS`` of them. Two vectors that meet
in a list are candidates when their permutations share at least ``SHARED`` pivots, and are linked when the
cosine in double precision is ``threshold`` or more. Pairs that meet in several lists are counted in the first one.

1. Identical vectors are one class from here on, with their number and smallest id; a vector with very many copies is one entry.
2. A list is compared in tiles of two blocks of about ``BLOCK`` entries, so that no task holds a long list whole. Only the number of
   links and a spanning forest of a tile leave it, never its pairs.
3. Components come from the forests; each row gets the figures of its class.

Pivots are fitted on a bounded sample: at most twice ``MOST_PIVOTS`` classes with the smallest digests, without those that are linked
to an earlier one. Every vector is indexed. What a pair at exactly 0.9 may lose is that none of its four nearest pivots is shared:
2 % of such pairs among 10,000 random vectors of 64 components, 0.3 % at 0.95, none at 0.98 (README).

Defined results: null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of
different lengths do not link; rows are compared whatever their ids, so repeated rows are copies that link with
each other; a component whose ids are all null has a null ``component_id`` and is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from reasonset.session import saved_once

from .common import table
from .components import components

LISTS, PERMUTATION, SHARED = 4, 16, 5
BLOCK, ROWS = 2048, 512
MOST_PIVOTS = 1 << 16

_READ = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("digest", pa.binary()), ("vector", pa.binary())])


def _read(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, digests, vectors = [], [], []
            for value in batch.column(1):
                x = None if not value.is_valid or value.values.null_count else value.values.to_numpy(zero_copy_only=False)
                if x is None or not len(x) or not x.any() or not np.isfinite(x).all():
                    dims, digests, vectors = [*dims, None], [*digests, None], [*vectors, None]
                    continue
                data = (x + 0.0).astype(kind).tobytes()  # without negative zeros
                dims.append(len(x))
                digests.append(blake2b(data, digest_size=16).digest())
                vectors.append(data)
            columns = [batch.column(0), *[pa.array(c, f.type) for c, f in zip((dims, digests, vectors), list(_READ)[1:])]]
            yield pa.RecordBatch.from_arrays(columns, schema=_READ)

    return run


def unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(classes: DataFrame, kind: str, threshold: float) -> dict[int, np.ndarray]:
    """Pivots per vector length, at most ``MOST_PIVOTS`` in all."""
    wanted = min(MOST_PIVOTS, math.ceil(math.sqrt(classes.count())))
    by_dim: dict[int, list[bytes]] = {}
    for row in classes.select("dim", "vector", "digest").orderBy("digest").limit(2 * wanted).collect():
        by_dim.setdefault(row["dim"], []).append(bytes(row["vector"]))
    out, found = {}, sum(map(len, by_dim.values()))
    for dim, vectors in by_dim.items():
        x, kept = unit(vectors, kind), []
        share = math.ceil(wanted * len(vectors) / found)
        for i in range(len(x)):
            if len(kept) < share and not (kept and (x[kept] @ x[i]).max() >= threshold):
                kept.append(i)
        out[dim] = x[kept]
    return out


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each row, in order."""
    k = min(PERMUTATION, len(pivots))
    near = x @ pivots.T
    some = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1).astype("<i4")


_ENTRY = "dim int, digest binary, weight long, vector binary, near binary, pivots array<int>"


def _describe(pivots: dict[int, np.ndarray], kind: str):
    schema = pa.schema([("dim", pa.int32()), ("digest", pa.binary()), ("weight", pa.int64()), ("vector", pa.binary()), ("near", pa.binary()), ("pivots", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                dims, vectors = batch.column(0).to_numpy(), batch.column(3).to_pylist()
                near = [b""] * len(dims)
                lists: list[list[int]] = [[-1]] * len(dims)  # a length without pivots has one list
                for dim in set(dims.tolist()) & set(pivots):
                    at = np.flatnonzero(dims == dim)
                    for i, row in zip(at, nearest(unit([vectors[i] for i in at], kind), pivots[dim])):
                        near[i], lists[i] = row.tobytes(), row[:LISTS].tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.binary()), pa.array(lists, pa.list_(pa.int32()))], schema=schema)

    return run


def _marks(near: np.ndarray, local: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
    """Which of the tile's pivots each row has, as a matrix of ones; ``held`` leaves out entries."""
    out = np.zeros((len(near), len(local)), np.float32)
    places = np.searchsorted(local, near)
    rows = np.broadcast_to(np.arange(len(near))[:, None], near.shape)
    chosen = np.ones(near.shape, bool) if held is None else held
    out[rows[chosen], places[chosen]] = 1
    return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes can reach by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


_LINKS = pa.schema([("digest", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])


def _tile(kind: str, threshold: float):
    def run(group: pa.Table) -> pa.Table:
        pivot, i, j = (group[c][0].as_py() for c in ("pivot", "i", "j"))
        block = group["block"].to_numpy()
        order = np.argsort(block != min(i, j), kind="stable")
        group, split = group.take(pa.array(order)), int((block == min(i, j)).sum()) if i != j else len(block)
        digests, weights = group["digest"].to_pylist(), group["weight"].to_numpy()
        x = unit(group["vector"].to_pylist(), kind)
        named = group["near"].to_pylist()
        near = np.frombuffer(b"".join(named), "<i4").reshape(len(x), len(named[0]) // 4)
        listed = near[:, :LISTS]
        local, early = np.unique(near), np.unique(listed[listed < pivot])
        shared, first = _marks(near, local), _marks(listed, early, listed < pivot)
        least = min(SHARED, near.shape[1])
        left = range(0, split, ROWS)
        right = slice(0, len(x)) if i == j else slice(split, len(x))
        found_a, found_b = [], []
        for start in left:
            rows = slice(start, min(split, start + ROWS))
            candidate = (shared[rows] @ shared[right].T >= least) & (first[rows] @ first[right].T == 0)
            a, b = np.nonzero(candidate & (x[rows] @ x[right].T >= threshold))
            a, b = a + rows.start, b + right.start
            once = a < b
            found_a.append(a[once])
            found_b.append(b[once])
        a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
        links = np.zeros(len(x), np.int64)
        np.add.at(links, a, weights[b])
        np.add.at(links, b, weights[a])
        label, at = roots(len(x), a, b), np.flatnonzero(links)
        columns = [[digests[k] for k in at], links[at], [digests[label[k]] for k in at]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINKS)], schema=_LINKS)

    return run


def linked(classes: DataFrame, kind: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """From classes (dim, digest, weight, vector): (digest, links, root) per class and tile, and the entries per list."""
    pivots = fit(classes, kind, threshold)
    entries = classes.select("dim", "digest", "weight", "vector").mapInArrow(_describe(pivots, kind), _ENTRY)
    listed = entries.withColumn("pivot", F.explode("pivots")).drop("pivots")
    # One row per list, of which there are at most MOST_PIVOTS and one per other length.
    sizes = saved_once(listed.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "lists")
    blocks = listed.join(sizes, ["dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    tiles = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("dim", "pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest", "weight", "vector", "near")
    return tiles.groupBy("dim", "pivot", "i", "j").applyInArrow(_tile(kind, threshold), "digest binary, links long, root binary"), sizes


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    only = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    rows = only.mapInArrow(_read(kind), "vec_id long, dim int, digest binary, vector binary")
    classes = saved_once(
        rows.where("digest IS NOT NULL").groupBy("dim", "digest").agg(F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("least")), "classes"
    )
    found = saved_once(linked(classes, kind, threshold)[0], "links")
    members = components(found.select(F.col("digest").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    named = saved_once(members.join(classes.select(F.col("digest").alias("node"), "least"), "node"), "members")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(smallest, "component").select(F.col("node").alias("digest"), "component_id")
    figures = classes.select("digest", "weight", "least").join(links, "digest", "left").join(of_class, "digest", "left")
    figures = figures.select("digest", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("vec_id", "digest").join(figures, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_pivot_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: By brute force; the index finds the same links wherever it misses none.
OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT i, vec_id, e, len(e) AS d FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.i, b.i AS j, b.vec_id AS other FROM ok a JOIN ok b ON a.d = b.d AND a.i <> b.i WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT i, i AS j FROM v UNION SELECT reach.i, link.j FROM reach JOIN link ON link.i = reach.j
), least AS (
  SELECT reach.i, min(v.vec_id) AS component_id FROM reach JOIN v ON v.i = reach.j GROUP BY reach.i
), n AS (SELECT i, count(*) AS n FROM link GROUP BY i)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (i) LEFT JOIN n USING (i)
"""
