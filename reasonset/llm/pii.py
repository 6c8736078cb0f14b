"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (``base_spans``) find e-mail addresses, IP addresses, card and telephone numbers. Each is written so that it takes
linear time on any text, and gives the leftmost, non-overlapping matches of its plain form. The field adds what they
miss, such as numbers that run into each other or that lack their prefix; a span of its own must pass a check of its kind and
touch no other.

Training. A labelled table is made of at most ``TRAIN_DOCS`` documents with digits, those of the smallest hashed ids, their
words labelled with the patterns; it is small and goes to the driver, where weights are fitted by full-batch gradient
steps. The same rows give the same field.

Decoding. A word without digit or at-sign can only be outside (a constraint of the field, in training as well), so every
path passes through the outside label there and the text falls apart, exactly, into runs of the other words. They
keep the shapes of their neighbours as features and are decoded by Viterbi in numpy batches of equal length.

Defined results: a null text counts as an empty one; spans are in code points, end exclusive; an empty table gives no rows, and a table without
digits an untrained field that adds nothing; repeated rows are judged one by one; other columns are not read (``redact`` passes them through).
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
TRAIN_DOCS, TRAIN_RUNS, TRAIN_RUN, STEPS, BUCKETS = 1000, 32, 12, 60, 1 << 12

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")
Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    at, until = text.find("@"), 0
    while at >= 0:
        start = at
        while start > until and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            until = found.end()
            yield start, until, 0
        else:
            # Later local parts cannot reach back over this sign.
            until = max(until, at + 1)
        at = text.find("@", max(until, at + 1))


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, kind by kind."""
    out = list(_emails(text))
    if _DIGITS.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(int(p) <= 255 if len(p) < 10 else not p.strip("0") or (len(p.lstrip("0")) < 4 and int(p.lstrip("0")) <= 255) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


# Words and their shapes


_INTERESTING = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"\S+")
_EDGE = "\"'.,;:!?()[]{}<>*#$&%|"


def shape(word: str) -> str:
    """Letters, digits and signs as classes; runs of letters as one, of digits by their number up to 4, then 5-9, 10-13, 14-19 and more.

    Words without digit or at-sign have one of six shapes. Every word is read whole; only those of usual length are remembered.
    """
    return _usual_shape(word) if len(word) <= 64 else _shape(word)


def _shape(word: str) -> str:
    if not _INTERESTING.search(word):
        bare = word.strip(_EDGE)
        if not bare:
            return "sign"
        kind = "upper" if bare.isupper() and len(bare) > 1 else "capital" if bare[0].isupper() else "lower"
        return kind if bare == word else f"{kind}+"
    out = []
    for run in re.findall(r"[0-9]+|[^\W\d_]+|.", word, re.DOTALL):
        n = len(run)
        out.append(("d" * n if n < 5 else "d5" if n < 10 else "d10" if n < 14 else "d14" if n < 20 else "d20") if run[0] in "0123456789" else "x" if run.isalpha() else run)
    return "".join(out)


_usual_shape = lru_cache(maxsize=100_000)(_shape)

BORDER = "border"


def _features(before: str, here: str, after: str) -> list[int]:
    digits = sum(c == "d" for c in here)
    names = (
        "bias", f"0{here}", f"-{before}", f"+{after}", f"-0{before}|{here}", f"0+{here}|{after}", f"@{'@' in here}{here.count('.')}", f"n{min(digits, 8)}{here[:1]}", f"e{here[-2:]}",
    )
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


class Field:
    """Weights of the field: features by label, and transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves
        self._scores: dict[tuple[str, str, str], np.ndarray] = {}

    def scores(self, before: str, here: str, after: str) -> np.ndarray:
        key = (before, here, after)
        found = self._scores.get(key)
        if found is None:
            if len(self._scores) > 100_000:
                self._scores.clear()
            found = self._scores[key] = self.weights[_features(*key)].sum(0)
        return found


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best label paths of a batch (sequences, words, labels) of equal lengths, each between outside words."""
    n, length, _ = scores.shape
    best = scores[:, 0] + moves[0]
    back = np.zeros((n, length, LABELS), np.int8)
    for t in range(1, length):
        paths = best[:, :, None] + moves[None]
        back[:, t] = paths.argmax(1)
        best = paths.max(1) + scores[:, t]
    path = np.zeros((n, length), np.int8)
    path[:, -1] = (best + moves[:, 0]).argmax(1)
    for t in range(length - 1, 0, -1):
        path[:, t - 1] = back[np.arange(n), t, path[:, t]]
    return path


def runs(text: str) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
    """The runs of words with a digit or at-sign: their places, and their shapes between those of their neighbours."""
    held: list[tuple[int, int]] = []
    at = 0
    while True:
        found = _INTERESTING.search(text, at)
        if found:
            start = found.start()
            while start > at and not text[start - 1].isspace():
                start -= 1
            space = _SPACE.search(text, found.end())
            end = space.start() if space else len(text)
        if held and (not found or text[held[-1][1] : start].strip()):
            yield held, [_neighbour(text, held[0][0], -1), *(shape(text[a:b]) for a, b in held), _neighbour(text, held[-1][1], 1)]
            held = []
        if not found:
            return
        held.append((start, end))
        at = end


def _neighbour(text: str, at: int, step: int) -> str:
    """The shape of the word before or after a place; together the neighbours of all runs go through a text twice at most."""
    if step > 0:
        found = _WORD.search(text, at)
        return shape(found[0]) if found else BORDER
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and not text[start - 1].isspace():
        start -= 1
    return shape(text[start:end]) if end else BORDER


def _sound(kind: int, found: str) -> bool:
    digits = "".join(_DIGITS.findall(found))
    if kind == 0:
        name, sign, host = found.partition("@")
        return bool(sign and name and host and "@" not in host and host[0].isalnum())
    if kind == 1:
        parts = found.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9\s./-]", found)
    return 10 <= len(digits) <= 15 and not re.search(r"[^0-9\s()./+-]", found) and (found[0] in "+(" or bool(re.search(r"[\s()./-]", found)))


def _spans_of(path: np.ndarray, places: list[tuple[int, int]], text: str) -> Iterator[Span]:
    k = 0
    while k < len(path):
        label = int(path[k])
        if not label or label % 2 == 0:
            k += 1
            continue
        kind, end = (label - 1) // 2, k + 1
        while end < len(path) and path[end] == label + 1:
            end += 1
        a, b = places[k][0], places[end - 1][1]
        lead, trail = _EDGE.replace("(", "") if kind == 3 else _EDGE, _EDGE
        while a < b and text[a] in lead:
            a += 1
        while b > a and text[b - 1] in trail:
            b -= 1
        if b > a and _sound(kind, text[a:b]):
            yield a, b, kind
        k = end


def all_spans(texts: list[str], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """Per text the spans of the patterns, and those with the field's added; each ordered by start and kind."""
    base = [sorted(base_spans(t), key=lambda s: (s[0], s[2])) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    if field is not None:
        waiting: dict[int, list] = {}
        for i, text in enumerate(texts):
            for places, shapes in runs(text):
                waiting.setdefault(len(places), []).append((i, places, shapes))
        for same in waiting.values():
            size = max(1, 8192 // len(same[0][1]))
            for start in range(0, len(same), size):
                part = same[start : start + size]
                scores = np.array([[field.scores(*shapes[t : t + 3]) for t in range(len(shapes) - 2)] for _, _, shapes in part])
                for (i, places, _), path in zip(part, viterbi(scores, field.moves)):
                    if path.any():
                        added[i] += _spans_of(path, places, texts[i])
    out = []
    for mine, more in zip(base, added):
        every, more = list(mine), sorted(more)
        j = 0
        reach = sorted((s[0], s[1]) for s in mine)
        for span in more:
            while j < len(reach) and reach[j][1] <= span[0]:
                j += 1
            if not any(a < span[1] and b > span[0] for a, b in reach[j : j + 8]):
                every.append(span)
        out.append((mine, sorted(every, key=lambda s: (s[0], s[2]))))
    return out


# Training


def label_table(docs: DataFrame, rows: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The labelled sample: ``shapes`` and ``labels`` of the runs in at most ``rows`` documents with digits, those of the smallest
    hashed ids; of each document its first ``TRAIN_RUNS`` runs of at most ``TRAIN_RUN`` words."""
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9]"))
    hashed = only.withColumn("h", F.xxhash64("doc_id", "text"))
    # Only hashes are ordered; the texts are then filtered where they are.
    last = hashed.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= F.lit(last)).limit(rows).select("text")
    return sample.mapInArrow(_label, "shapes array<string>, labels array<int>")


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [r for text in batch.column(0).to_pylist() for r in islice((r for r in labelled(text) if len(r[1]) <= TRAIN_RUN), TRAIN_RUNS)]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.list_(pa.string())), pa.array([x for _, x in found], pa.list_(pa.int32()))], ["shapes", "labels"])


def labelled(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """Runs of words: shapes with those of the neighbours, and labels by the patterns."""
    spans = base_spans(text)
    for places, shapes in runs(text):
        labels = [0] * len(places)
        for start, end, kind in spans:
            inside = [i for i, (a, b) in enumerate(places) if a < end and b > start]
            for i in inside:
                labels[i] = 2 * kind + (1 if i == inside[0] else 2)
        yield shapes, labels


def train(rows: list[tuple[list[str], list[int]]], steps: int = STEPS) -> Field | None:
    """Fits the field to labelled runs by full-batch gradient steps; none if nothing in them is labelled.

    Equal contexts are summed before their features are.
    """
    if not any(any(labels) for _, labels in rows):
        return None
    contexts: dict[tuple[str, str, str], int] = {}
    n, length = len(rows), max(len(labels) for _, labels in rows)
    at, gold, held = np.zeros((n, length), np.int64), np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for i, (shapes, labels) in enumerate(rows):
        at[i, : len(labels)] = [contexts.setdefault(tuple(shapes[t : t + 3]), len(contexts)) for t in range(len(labels))]
        gold[i, : len(labels)], held[i, : len(labels)] = labels, True
    feats = np.array([_features(*c) for c in contexts])
    last = held.sum(1) - 1
    rows_at = np.arange(n)

    def per_context(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(contexts), LABELS))
        np.add.at(out, at[held], values)
        weights_of = np.zeros((BUCKETS, LABELS))
        np.add.at(weights_of, feats, out[:, None, :])
        return weights_of

    weights, moves = np.zeros((BUCKETS, LABELS)), np.zeros((LABELS, LABELS))
    seen_w, seen_m = per_context(np.eye(LABELS)[gold[held]]), np.zeros_like(moves)
    np.add.at(seen_m, (np.zeros(n, np.int64), gold[:, 0]), 1)
    np.add.at(seen_m, (gold[:, :-1][held[:, 1:]], gold[:, 1:][held[:, 1:]]), 1)
    np.add.at(seen_m, (gold[rows_at, last], np.zeros(n, np.int64)), 1)
    sum_w, sum_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(steps):
        scores = weights[feats].sum(1)[at]
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0] + moves[0]
        for t in range(1, length):
            ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves[None], axis=1) + scores[:, t]
        for t in range(length - 1, -1, -1):
            if t < length - 1:
                behind[:, t] = np.logaddexp.reduce(moves[None] + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[last == t, t] = moves[:, 0]  # after its last word a run meets an outside word
        total = np.logaddexp.reduce(ahead[:, 0] + behind[:, 0], axis=1)
        share = np.exp(np.minimum(ahead + behind - total[:, None, None], 0)) * held[..., None]
        expected_m = np.zeros_like(moves)
        expected_m[0] += share[:, 0].sum(0)
        expected_m[:, 0] += share[rows_at, last].sum(0)
        for t in range(1, length):
            on = held[:, t]
            both = ahead[on, t - 1, :, None] + moves[None] + (scores[on, t] + behind[on, t])[:, None, :] - total[on, None, None]
            expected_m += np.exp(both).sum(0)
        g_w, g_m = seen_w - per_context(share[held]) - 0.01 * weights, seen_m - expected_m - 0.01 * moves
        sum_w, sum_m = sum_w + g_w**2, sum_m + g_m**2
        weights, moves = weights + 0.5 * g_w / np.sqrt(sum_w), moves + 0.5 * g_m / np.sqrt(sum_m)
    return Field(weights, moves)


def fit(docs: DataFrame, rows: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    rows = [(row["shapes"], row["labels"]) for row in label_table(docs, rows, id_col, text_col).collect()]
    return train(sorted(rows))


# Operators


def _text_of(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = pickle.loads(shared.value)
        for batch in small_batches(batches, "text"):
            found = all_spans([t or "" for t in batch.column(1).to_pylist()], field)
            counts = [[sum(s[2] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([_text_of(b) for b, _ in found], pa.string()), pa.array([_text_of(e) for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return run


def _shared(docs: DataFrame, field: Field | None):
    return docs.sparkSession.sparkContext.broadcast(pickle.dumps(field))


def find(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts and spans (``kind:start:end``) of the patterns (``base``), and ``spans`` with those of the field."""
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = only.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return only.mapInArrow(_find(_shared(docs, field)), f"doc_id {kind}, {counts}, base string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping ones, replaced by the kind of its first in angle brackets."""
    out, at = [], 0
    spans, k = sorted(spans, key=lambda s: (s[0], s[2])), 0
    while k < len(spans):
        start, end, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            k += 1
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def _redact(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = pickle.loads(shared.value)
        for batch in small_batches(batches, "text"):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            found = all_spans([t or "" for t in texts], field)
            new = [redacted(t, every) if t is not None and every else t for t, (_, every) in zip(texts, found)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return run


def redact(docs: DataFrame, field: Field | None, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows with personal data replaced in their texts; ``chars_col``, where there is one, is counted anew."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).alias("text"))
    done = held.mapInArrow(_redact(_shared(docs, field)), held.schema)
    out = done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    if chars_col not in docs.columns:
        return out
    kind = docs.schema[chars_col].dataType
    return out.withColumn(chars_col, F.when(F.col(text_col).isNotNull(), F.length(text_col)).cast(kind))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = find(docs, fit(docs))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
