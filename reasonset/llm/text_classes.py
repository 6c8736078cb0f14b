"""Classes of near-duplicate texts by one-permutation signatures, for operators that only need to know which texts are alike.

A text is the plain set of its distinct shingles of five words. One hash per shingle gives the whole signature: the
hash's leading bits name one of 80 bins, and each bin keeps its smallest hash; an empty bin borrows from the first filled one in
a fixed random order of its own. Sixteen bands of five bins give the candidates. Everything behind them is that of
``near_dup``: exact verification by Jaccard similarity (here unweighted), leaders, blocks, components.

Banding loses a pair with a similarity of 0.8 with a probability of 0.002, less above; texts of few shingles borrow most of their bins, so
that theirs agree less independently (see the README for the measured recall).

Defined results are those of ``near_dup``: null and empty texts belong to no class, texts of one to four words are one shingle,
repeated rows and copies are one text. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonset.session import saved_once

from .common import small_batches
from .near_dup import THRESHOLD, WORDS, _mixed, _texts, classes_of, word_hashes

BANDS, ROWS = 16, 5
BINS = BANDS * ROWS

_U = np.uint64
_EMPTY = np.iinfo(np.uint64).max
#: Per bin the order in which it looks for another one to borrow from; the first is itself.
_ORDER = np.argsort(np.random.Generator(np.random.PCG64(5)).random((BINS, BINS)) + (1 - np.eye(BINS)), axis=1, kind="stable")


def shingle_hashes(words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of some texts, cut where each starts: the hash of each shingle, and its text."""
    sizes = np.diff(cuts)
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    # A word that is missing at the end counts as zero.
    padded = np.concatenate([words, np.zeros(WORDS, _U)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.flatnonzero(np.arange(len(words)) + WORDS <= cuts[1:][owner]) if len(words) else np.zeros(0, np.int64)
    at = np.concatenate([whole, cuts[short]]).astype(np.int64)
    text = np.concatenate([owner[whole], short]).astype(np.int64)
    joined = np.zeros(len(at), _U)
    for k in range(WORDS):
        inside = at + k < cuts[1:][text]
        joined = (joined + np.where(inside, padded[at + k], _U(0))) * _U(0xD6E8FEB86659FD93)
    return _mixed(joined), text


def bins(hashes: np.ndarray, text: np.ndarray, rows: int) -> np.ndarray:
    """(rows, bins): the smallest hash of each bin, borrowed where a bin is empty; rows without shingles stay empty."""
    slot = text * BINS + ((hashes >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    least = np.full(rows * BINS, _EMPTY, _U)
    np.minimum.at(least, slot, hashes)
    least = least.reshape(rows, BINS)
    some = np.zeros(rows, bool)
    some[text] = True
    out = least.copy()
    row, column = np.nonzero((out == _EMPTY) & some[:, None])
    for step in range(1, BINS):
        if not len(row):
            break
        out[row, column] = least[row, _ORDER[column, step]]
        still = out[row, column] == _EMPTY
        row, column = row[still], column[still]
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """(rows, bands): one key per band."""
    keys = np.broadcast_to(np.arange(BANDS, dtype=_U) + _U(1), (len(values), BANDS))
    for k in range(ROWS):
        keys = _mixed(keys * _U(0x9E3779B97F4A7C15) + values.reshape(len(values), BANDS, ROWS)[:, :, k])
    return keys


def plain_set(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of the text in a column of one row in ascending order, each weighing 1."""
    found = np.unique(shingle_hashes(*word_hashes(column))[0])
    return found, np.ones(len(found), np.float32)


def _distinct(hashes: np.ndarray, text: np.ndarray, rows: int) -> np.ndarray:
    """The number of distinct shingles per text, told apart by the hash bits that one number leaves beside the text's place."""
    shift = _U(max(rows - 1, 1).bit_length())
    keys = np.sort((text.astype(_U) << (_U(64) - shift)) | (hashes >> shift))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[first] >> (_U(64) - shift)).astype(np.int64), minlength=rows)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 1 << 20):
        column = batch.column(1)
        rows = len(column)
        words, cuts = word_hashes(column)
        hashes, text = shingle_hashes(words, cuts)
        sizes = _distinct(hashes, text, rows)
        keys = bands(bins(hashes, text, rows)).astype(np.int64)
        none = sizes == 0
        held = [None if empty else column[i].as_buffer() for i, empty in enumerate(none.tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([None if b is None else hashlib.md5(b, usedforsecurity=False).digest() for b in held], pa.binary()),
                pa.array(sizes.astype(np.float64), pa.float64(), mask=none),
                pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BANDS, pa.int32()), pa.array(keys.ravel()), mask=pa.array(none)),
                pa.array([None if b is None else b.size for b in held], pa.int64()),
            ],
            ["doc_id", "tid", "weight", "bands", "size"],
        )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digest of the text (``tid``), distinct shingles (``weight``), band keys, bytes of the text; all but the id null without words."""
    return _texts(docs, id_col, text_col).mapInArrow(_sign, "doc_id long, tid binary, weight double, bands array<bigint>, size long")


def linked_texts(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(tid, component): the class of each text, by its digest, that has a near duplicate with another text."""
    signed = saved_once(signatures(docs, id_col, text_col), "signatures")
    return classes_of(docs, signed, plain_set, threshold, id_col, text_col)[1].select(F.col("node").alias("tid"), "component")
