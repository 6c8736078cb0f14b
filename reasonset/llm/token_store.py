"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk
of those ids that have one, and so on; a bitmap per level tells which ids continue, and a rank directory
counts its ones every 512 bits. The token at any position is found by one rank per level; no block is decoded.

Files: ``blocks`` (Parquet rows, each a block of whole documents with its levels, bitmaps and ranks, and the
numbers of its documents) and nothing else: absolute positions follow from the blocks' sizes.

Documents are dealt by ranges of ``doc_id``, so that parts are in ascending order and each is written as a
stream; where an id begins in the whole store is a running sum over parts, one row per part.

Defined results: a null text counts as an empty one and has only the end id; null ids come first; rows with
equal ids stay separate, ordered by a hash of their texts and then the texts; an empty table gives an empty store; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from reasonset.session import shared_folder

from .common import small_batches, table
from .word_memo import LibraryTexts, WordMemo, WordPieces, supported

BLOCK_IDS = 1 << 18
RANK_BITS = 512
BLOCKS = (
    "part int, block int, first long, n_ids long, doc_ids array<bigint>, doc_starts array<bigint>, "
    "levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)


@dataclass
class Codes:
    """The directly addressable codes of a run of ids."""

    n: int
    levels: list[np.ndarray]
    bitmaps: list[np.ndarray]
    ranks: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        rest, levels, bitmaps, ranks = ids.astype(np.uint64), [], [], []
        while True:
            levels.append((rest & 255).astype(np.uint8))
            more = rest > 255
            bits = np.packbits(more, bitorder="little")
            bitmaps.append(bits)
            ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % (RANK_BITS // 8)))).reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32)
            ranks.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4"))
            rest = rest[more] >> 8
            if not len(rest):
                return cls(len(ids), levels, bitmaps, ranks)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at the given places, each found by itself."""
        out = np.zeros(len(places), np.uint32)
        asked, at = np.arange(len(places)), np.asarray(places, np.int64)
        for k, (chunk, bits) in enumerate(zip(self.levels, self.bitmaps)):
            out[asked] |= chunk[at].astype(np.uint32) << np.uint32(8 * k)
            more = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            asked, at = asked[more], at[more]
            if not len(at):
                break
            at = self._rank(k, at)
        return out

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many ids before each place continue: the directory's count and the ones of its own 512 bits."""
        start = at // RANK_BITS
        counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bitmaps[level]), dtype=np.int64)]) if len(at) > RANK_BITS else None
        whole = at >> 3
        if counts is not None:  # for many places one running count of the bytes gives the ones inside all the 512 bits
            before = self.ranks[level][start].astype(np.int64) + counts[whole] - counts[start * (RANK_BITS // 8)]
        else:
            bits = self.bitmaps[level]
            before = np.array([int(self.ranks[level][s]) + int(np.bitwise_count(bits[s * RANK_BITS // 8 : w]).sum()) for s, w in zip(start, whole)], np.int64)
        last = self.bitmaps[level][whole] & ((1 << (at & 7).astype(np.uint16)) - 1).astype(np.uint8)
        return before + np.bitwise_count(last)


def _joined_words(pieces: list[str], bare: Tokenizer, ends: np.ndarray, dtype: np.dtype) -> dict[str, bytes]:
    """Ids of many pieces in one call; a piece's last id is one that ends a word."""
    ids = np.array(bare.encode(" ".join(pieces), add_special_tokens=False).ids, np.int64)
    stops = np.flatnonzero(ends[ids]) + 1
    packed = ids.astype(dtype).tobytes()
    starts, size = np.concatenate([[0], stops[:-1]]), dtype.itemsize
    return {p: packed[a * size : b * size] for p, a, b in zip(pieces, starts.tolist(), stops.tolist())}


@lru_cache(maxsize=2)
def library_encoder(path: str) -> WordMemo | LibraryTexts:
    """Encodes with the tokenizers library; pieces that chunks share are encoded once per call."""
    if not supported(json.loads(open(path, encoding="utf-8").read())):
        return LibraryTexts(path)
    prepared = WordPieces(path)
    vocabulary, merges = prepared.model["vocab"], [tuple(m) for m in prepared.model["merges"]]
    bare = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, end_of_word_suffix=prepared.suffix, cache_capacity=0))
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    size = max([*vocabulary.values(), *prepared.added.values()]) + 1
    dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    ends = np.zeros(size, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(prepared.suffix)]] = True
    prepared.model = None  # as large as the encoder, and not needed any more

    def resolve(words: list[str]) -> list[bytes]:
        cut = [prepared.parts(word) for word in words]
        new = list({p for found in cut for p in found if isinstance(p, str)})
        known = _joined_words(new, bare, ends, dtype) if new else {}
        return [b"".join([known[p] if isinstance(p, str) else dtype.type(p).tobytes() for p in found]) for found in cut]

    return WordMemo(resolve, dtype.str, list(prepared.added))


def _write_part(path: str, end_id: int | None, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library_encoder(path), TaskContext.get().partitionId()
        tail = [] if end_id is None else [np.array([end_id], np.uint32)]
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        starts: list[int] = []
        n = block = first = 0

        def flush():
            nonlocal held, docs, starts, n, block, first
            codes = Codes.of(np.concatenate(held))
            row = {
                "part": part, "block": block, "first": first, "n_ids": n, "doc_ids": docs, "doc_starts": starts,
                "levels": [x.tobytes() for x in codes.levels], "bitmaps": [x.tobytes() for x in codes.bitmaps], "ranks": [x.tobytes() for x in codes.ranks],
            }
            held, docs, starts, n, block, first = [], [], [], 0, block + 1, first + n
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in small_batches(batches, "text"):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                if n and n + len(ids) > block_ids:
                    yield flush()
                docs.append(doc_id)
                starts.append(n)
                held += [ids.astype(np.uint32), *tail]
                n += len(ids) + len(tail)
        if docs:
            yield flush()

    return run


_ARROW = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "doc_starts")]
    + [(c, pa.list_(pa.binary())) for c in ("levels", "bitmaps", "ranks")]
)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encodes whole texts and writes them in ascending order of their ids; a block ends before the document that would exceed ``block_ids``."""
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = only.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    blocks = ordered.select("doc_id", "text").mapInArrow(_write_part(tokenizer, end_id, block_ids), BLOCKS)
    blocks.write.option("compression", "snappy").parquet(f"{folder}/blocks")


def part_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, part_start): how many ids stand before each part; one row per part."""
    parts = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def _codes(row: dict) -> Codes:
    of = lambda name, kind: [np.frombuffer(x, kind) for x in row[name]]
    return Codes(row["n_ids"], of("levels", np.uint8), of("bitmaps", np.uint8), of("ranks", "<u4"))


def _read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = _codes(row).at(np.arange(row["n_ids"]))
            cuts = [*row["doc_starts"], row["n_ids"]]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": [row["part"]] * len(row["doc_ids"]),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array([row["first"] + s for s in row["doc_starts"]], pa.int64()),
                    "ids": pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                },
                schema=pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())]),
            )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: ``doc_id``, ``start`` in the whole store, and ``ids`` as little-endian 32-bit integers."""
    docs = spark.read.parquet(f"{folder}/blocks").mapInArrow(_read_docs, "part int, doc_id long, start long, ids binary")
    # One short row per written part, of which there are as many as shuffle partitions: never the size of the data.
    return docs.join(F.broadcast(part_starts(spark, folder)), "part").select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), "ids")


def tokens_at(spark: SparkSession, folder: str, position: int) -> int | None:
    """The id at one position of the whole store, from the one block that holds it; null beyond the end."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    starts = part_starts(spark, folder).where(F.col("part_start") <= position).orderBy(F.desc("part_start"), F.desc("part")).limit(1).collect()
    if not starts or position < 0:
        return None
    place = position - starts[0]["part_start"]
    rows = blocks.where((F.col("part") == starts[0]["part"]) & (F.col("first") <= place) & (F.col("first") + F.col("n_ids") > place)).collect()
    return int(_codes(rows[0].asDict()).at(np.array([place - rows[0]["first"]]))[0]) if rows else None


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, folder).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
