"""Byte-pair encoding with forced boundaries, and decoding.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be bridged by a merge, so a
piece may be cut between them before any merge is looked at. The fragments are encoded independently, each
distinct chunk of text once, and their ids concatenated; the result is that of the whole piece. A final byte
carries the end-of-word mark, so pairs with it are counted apart from pairs without it.

The library's BPE model merges inside a fragment, by the ranks of the tokenizer file. Normalization, cutting into pieces and
added tokens are those of the file (others than ``word_memo.supported`` are refused); texts are cut into chunks first, which no
piece crosses. Encoding and decoding share one pass over the rows, and one memory of bounded bytes.

Defined results: null and empty texts have no ids and decode to an empty text; ids without a token are left
out on decoding; rows are encoded one by one, so repeated rows and ties need no rule; null document ids pass
through and other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import models

from .common import small_batches, table
from .word_memo import WordMemo, WordPieces


class ForcedBoundaryEncoder:
    """Encodes pieces in the byte alphabet."""

    def __init__(self, prepared: WordPieces):
        model, self.suffix = prepared.model, prepared.suffix
        merges = [tuple(m) for m in model["merges"]]
        # Only the last fragment of a piece ends with the end-of-word mark.
        self.ending = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix, cache_capacity=0)
        self.inside = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0)
        self.inner: set[tuple[str, str]] = set()
        self.final: set[tuple[str, str]] = set()
        for token in model["vocab"]:
            body, ends = (token[: -len(self.suffix)], True) if self.suffix and token.endswith(self.suffix) else (token, not self.suffix)
            pairs = list(zip(body, body[1:]))
            self.inner.update(pairs if not self.suffix else pairs[:-1] if ends else pairs)
            self.final.update(pairs[-1:] if ends else [])

    def cuts(self, piece: str) -> Iterator[tuple[str, bool]]:
        """The fragments of a piece, and whether each is its last."""
        start, last = 0, len(piece) - 1
        for i in range(last):
            pair = (piece[i], piece[i + 1])
            if pair not in (self.final if i + 1 == last else self.inner):
                yield piece[start : i + 1], False
                start = i + 1
        yield piece[start:], True

    def encode(self, piece: str) -> list[int]:
        return [i for fragment in self.cuts(piece) for i in self._merge(*fragment)]

    def _merge(self, fragment: str, last: bool) -> list[int]:
        """The merges of one fragment, by the ranks of the file."""
        return [token.id for token in (self.ending if last else self.inside).tokenize(fragment)]


@lru_cache(maxsize=2)
def forced_encoder(path: str) -> WordMemo:
    prepared = WordPieces(path)
    encoder = ForcedBoundaryEncoder(prepared)

    def resolve(words: list[str]) -> list[bytes]:
        pieces: dict[str, list[int]] = {}
        out = []
        for word in words:
            ids: list[int] = []
            for part in prepared.parts(word):
                if isinstance(part, int):
                    ids.append(part)
                    continue
                if part not in pieces:
                    pieces[part] = encoder.encode(part)
                ids += pieces[part]
            out.append(np.array(ids, "<u4").tobytes())
        return out

    prepared.model = None  # as large as both encoders, and not needed any more
    return WordMemo(resolve, "<u4", list(prepared.added))


@lru_cache(maxsize=2)
def token_texts(path: str) -> pa.Array:
    """What each id stands for in the decoded text, with a blank behind it; null for ids without a token.

    The library joins the tokens of a file without a decoder by blanks, end-of-word marks and byte alphabet as they stand.
    """
    spec = json.loads(open(path, encoding="utf-8").read())
    vocabulary = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    out: list[bytes | None] = [None] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = token.encode() + b" " if token else None
    return pa.array(out, pa.large_binary())


def decoded(path: str, flat: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The texts of runs of ids that lie behind each other."""
    known = token_texts(path)
    flat = flat.astype(np.int64)
    inside = (flat >= 0) & (flat < len(known))
    found = known.take(pa.array(np.where(inside, flat, 0), mask=~inside))
    offsets = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)[bounds]
    data = found.buffers()[2].to_pybytes() if len(found) else b""
    return [data[a : max(a, b - 1)].decode() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]


_IDS = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]


def _encode(path: str, back: bool):
    schema = pa.schema([*_IDS, ("text", pa.string())] if back else _IDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = forced_encoder(path)
        for batch in small_batches(batches, "text", 2 << 20):
            flat, bounds = encoder.encode_flat([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32)))
            texts = [pa.array(decoded(path, flat, bounds), pa.string())] if back else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, *texts], schema=schema)

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``ids`` of the whole text."""
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return only.mapInArrow(_encode(tokenizer, False), "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``ids`` of the whole text, and the ``text`` that they decode to, in one pass."""
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return only.mapInArrow(_encode(tokenizer, True), "doc_id long, ids array<int>, text string")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                bounds = part.column(1).offsets.to_numpy().astype(np.int64)
                flat = part.column(1).values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy(zero_copy_only=False)
                texts = pa.array(decoded(path, flat, bounds - bounds[0]), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["doc_id", "ids", "text"])

    return run


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Adds the decoded ``text`` to rows of ``doc_id`` and ``ids``."""
    only = encoded.select("doc_id", F.filter(F.coalesce("ids", F.array().cast("array<int>")), lambda i: i.isNotNull()).alias("ids"))
    return only.mapInArrow(_decode(tokenizer), "doc_id long, ids array<int>, text string")


def op7_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = round_trip(table(spark, sf_dir, "documents"), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
