"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word of a piece of text begins a suffix of at most three words. Suffixes are routed by their leading words to ranges of
the lexicographic order, so that all suffixes with the same leading words meet; the cuts between ranges are suffixes of a
bounded sample of documents, by which only the balance of the ranges depends. In a range, a three-way quicksort
partitions the pointers by their first word, the equal partition goes on with the second word, and so to the
third. The size of an equal partition is the count of its phrase; a partition that holds fewer than ``least`` suffixes
cannot hold a phrase that is wanted and is abandoned. All partitions of a range are split in the same round.

Before they are routed, equal suffixes of about ``CHUNK_WORDS`` words become one with its count, so that frequent phrases are
as many rows as there are chunks. A leading word or pair that is frequent spans several ranges, because the cuts lie
inside it; the at most four prefixes that a range shares with its neighbours are given as parts and summed at the end.

Defined results: a null or empty text has no words; a null language counts as ``und``; rows are taken as they are, so repeated
rows count each; ties in the ranking are complete (score, count, phrase); an empty table gives no rows; a text of any length is
read in chunks that overlap by two words; other columns are not read. Scores are exact for counts below 10**16.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from reasonset.session import saved_once

from .common import small_batches, table

DEPTH, CHUNK_WORDS, CHUNK_BYTES = 3, 1 << 21, 16 << 20
#: The bounded sample behind the cuts: documents, and suffixes of each.
SAMPLE_DOCS, SAMPLE_SUFFIXES = 4096, 256
RANGES_PER_PARTITION = 4

# Lower case for A-Z; what ends a piece becomes a line feed and what ends a word a space.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")

Suffix = tuple[bytes, bytes, bytes]


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts in order, and the number of the piece that each belongs to."""
    buffer = np.frombuffer(b"\n".join(texts).translate(_TABLE), np.uint8)
    ends_piece = buffer == 10
    inside = ~(ends_piece | (buffer == 32))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buffer[inside])])
    return words, np.cumsum(ends_piece, dtype=np.int64)[starts]


def suffixes(words: pa.Array, piece: np.ndarray, begun: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The vocabulary in order, and the distinct suffixes that start at the first ``begun`` words, in order, with their counts.

    A suffix is three codes of 21 bits; 0 stands for no word, others are one more than the place in the vocabulary.
    """
    encoded = words.dictionary_encode()
    order = pc.array_sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    codes = rank[encoded.indices.to_numpy()]
    keys = codes[:begun] << 42
    for ahead in range(1, DEPTH):
        same = piece[ahead : ahead + begun] == piece[: max(0, min(begun, len(piece) - ahead))]
        keys[: len(same)] |= np.where(same, codes[ahead : ahead + begun], 0) << (21 * (DEPTH - 1 - ahead))
    keys, counts = np.unique(keys, return_counts=True)
    return encoded.dictionary.take(pa.array(order)), keys, counts


def _unpacked(keys: np.ndarray) -> list[np.ndarray]:
    return [(keys >> (21 * (DEPTH - 1 - d))) & ((1 << 21) - 1) for d in range(DEPTH)]


def _bound(vocabulary: list[bytes], cut: Suffix) -> int:
    """The least key of a suffix that is not below the cut."""
    key = 0
    for d, word in enumerate(cut):
        code = bisect_left(vocabulary, word) if word else -1
        key |= (code + 1) << (21 * (DEPTH - 1 - d))
        if word and (code == len(vocabulary) or vocabulary[code] != word):
            break
    return key


def pack(vocabulary: pa.Array, keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted suffixes as a tree: words of each level, and how many children each has; the last level has the counts."""
    parts: list[bytes] = []
    codes, first = _unpacked(keys), np.zeros(len(keys), bool)
    first[:1] = True
    for d in range(DEPTH):
        first[1:] |= codes[d][1:] != codes[d][:-1]
        at = np.flatnonzero(first)
        text = vocabulary.take(pa.array(codes[d][at]))
        offsets, data = np.frombuffer(text.buffers()[1], np.int64)[text.offset :][: len(text) + 1], text.buffers()[2]
        sizes = counts if d == DEPTH - 1 else np.diff(np.append(at, len(keys)))
        parts += [data[offsets[0] : offsets[-1]].to_pybytes(), sizes.astype("<u4").tobytes()]
    head = np.array([len(p) for p in parts], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpack(packed: bytes) -> tuple[list[pa.Array], list[np.ndarray], np.ndarray]:
    """Per level the words, each with a line feed behind it, and for every suffix the place of its word; the counts."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum([8 * 2 * DEPTH, *np.frombuffer(raw, "<i8", 2 * DEPTH)])
    levels, places, spans = [], [], None
    for d in range(DEPTH):
        text = np.frombuffer(raw, np.uint8, ends[2 * d + 1] - ends[2 * d], ends[2 * d])
        offsets = np.concatenate([[0], np.flatnonzero(text == 10) + 1]).astype(np.int64)
        levels.append(pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(text)]))
        spans = np.frombuffer(raw, "<u4", (ends[2 * d + 2] - ends[2 * d + 1]) // 4, ends[2 * d + 1]).astype(np.int64)
        places.append(np.arange(len(spans)) if d == DEPTH - 1 else np.repeat(np.arange(len(spans)), spans))
    return levels, places, spans


def quicksort_counts(codes: np.ndarray, weights: np.ndarray, least: int, absent: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per depth (a pointer to one suffix, its count) for every phrase of that many words that occurs ``least`` times or more.

    ``codes`` has a row per depth; ``absent`` is the code per depth that stands for no word. Each round partitions every
    remaining segment of pointers around the word in its middle; a segment is ``size`` neighbours in ``at``.
    """
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    found = [[empty] for _ in codes]
    flat, width = np.ascontiguousarray(codes).reshape(-1), codes.shape[1]
    at, size, depth = np.arange(width, dtype=np.int32), np.array([width]), np.zeros(1, np.int64)
    none = np.array(absent)
    while len(at):
        here = flat[at + np.repeat(depth * width, size)]
        start = np.cumsum(size) - size
        pivot = here[start + size // 2]
        wanted = np.repeat(pivot, size)
        word = pivot != none[depth]
        kept = []
        for equal, side in ((False, here < wanted), (True, here == wanted), (False, here > wanted)):
            rows = np.add.reduceat(side, start, dtype=np.int64)
            chosen = at[side]
            filled = rows > 0
            begin = np.cumsum(rows) - rows
            weight = np.zeros(len(rows), np.int64)
            weight[filled] = np.add.reduceat(weights[chosen], begin[filled]) if len(chosen) else 0
            alive, below = weight >= least, depth + equal
            if equal:
                alive &= word
                for d in range(len(codes)):
                    hit = alive & (depth == d)
                    found[d].append((chosen[begin[hit]], weight[hit]))
                alive &= below < len(codes)
            kept.append((chosen[np.repeat(alive, rows)], rows[alive], below[alive]))
        at, size, depth = (np.concatenate(parts) for parts in zip(*kept))
    return [(np.concatenate([a for a, _ in f]), np.concatenate([w for _, w in f])) for f in found]


_ROUTED = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("packed", pa.binary())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, int]]:
    """(language, words, pieces, words that begin a suffix here)."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def cut():
        for lang, texts in held.items():
            words, piece = words_of(texts)
            for start in range(0, len(words), CHUNK_WORDS):
                stop = min(len(words), start + CHUNK_WORDS + DEPTH - 1)
                yield lang, words[start:stop], piece[start:stop], min(CHUNK_WORDS, len(words) - start)

    for batch in small_batches(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if text:
                held.setdefault(lang, []).append(text)
                size += len(text)
        if size > CHUNK_BYTES:
            yield from cut()
            held, size = {}, 0
    yield from cut()


def _route(cuts: list[tuple[str, Suffix]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, piece, begun in _chunks(batches):
            vocabulary, keys, counts = suffixes(words, piece, begun)
            known = vocabulary.to_pylist()
            shown = pc.binary_join_element_wise(pa.concat_arrays([pa.array([b""], pa.large_binary()), vocabulary]), pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
            low, high = bisect_left(cuts, (lang,)), bisect_left(cuts, (lang + "\0",))
            places = [0, *np.searchsorted(keys, [_bound(known, cut) for _, cut in cuts[low:high]]).tolist(), len(keys)]
            for k, (a, b) in enumerate(zip(places, places[1:])):
                if a < b:
                    packed = pack(shown, keys[a:b], counts[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([low + k], [lang], [packed]), _ROUTED)], schema=_ROUTED)

    return run


_COUNTS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64()), ("part", pa.bool_())])


def _count(cuts: list[tuple[str, Suffix]], least: int):
    def of_lang(number: int, lang: str, packed: list[bytes]) -> Iterator[tuple]:
        read = [unpack(p) for p in packed]
        codes, shown = [], []
        for d in range(DEPTH):
            level = pa.chunked_array([levels[d] for levels, _, _ in read]).combine_chunks().dictionary_encode()
            index = level.indices.to_numpy()
            starts = np.cumsum([0, *[len(levels[d]) for levels, _, _ in read]])
            codes.append(np.concatenate([index[s + places[d]] for s, (_, places, _) in zip(starts, read)]))
            shown.append([w[:-1] for w in level.dictionary.to_pylist()])
        weights = np.concatenate([counts for _, _, counts in read])
        yield lang, 0, None, int(weights.sum()), True
        # Prefixes of the cuts at both ends may go on in the neighbouring ranges.
        shared = {cut[:d] for of, cut in cuts[max(0, number - 1) : number + 1] if of == lang for d in range(1, DEPTH) if cut[d - 1]}
        for prefix in sorted(shared):
            match = np.ones(len(weights), bool)
            for d, word in enumerate(prefix):
                match &= codes[d] == (shown[d].index(word) if word in shown[d] else -1)
            if match.any():
                yield lang, len(prefix), b" ".join(prefix).decode(), int(weights[match].sum()), True
        absent = [s.index(b"") if b"" in s else -1 for s in shown]
        for d, (at, weight) in enumerate(quicksort_counts(np.stack(codes), weights, least, absent)):
            for words, f in zip(zip(*(codes[k][at].tolist() for k in range(d + 1))), weight.tolist()):
                prefix = tuple(shown[k][c] for k, c in enumerate(words))
                if prefix not in shared:
                    yield lang, d + 1, b" ".join(prefix).decode(), f, False

    def run(group: pa.Table) -> pa.Table:
        number, langs, packed = group["range"][0].as_py(), group["lang"].to_pylist(), group["packed"].to_pylist()
        rows = [row for lang in sorted(set(langs)) for row in of_lang(number, lang, [p for of, p in zip(langs, packed) if of == lang])]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COUNTS)], schema=_COUNTS)

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            words, piece = words_of([text or b""])
            for i in range(0, len(words), max(16, len(words) // SAMPLE_SUFFIXES)):
                same = [words[j].as_py() if j < len(words) and piece[j] == piece[i] else b"" for j in range(i, i + DEPTH)]
                rows.append((lang, *same))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, [pa.string(), *[pa.binary()] * 3])], ["lang", "a", "b", "c"])


def _cuts(texts: DataFrame, ranges: int) -> list[tuple[str, Suffix]]:
    """Suffixes that cut a bounded sample into even ranges; at most ``ranges`` - 1 of them."""
    rows = texts.count()
    sample = texts if rows <= SAMPLE_DOCS else texts.sample(SAMPLE_DOCS / rows, 7)
    found = sorted((r[0], (bytes(r[1]), bytes(r[2]), bytes(r[3]))) for r in sample.mapInArrow(_sampled, "lang string, a binary, b binary, c binary").collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def phrase_counts(docs: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``words``, ``phrase`` and ``f`` for every phrase of one to three words that occurs ``least`` times or more in a language.

    Rows with 0 words and a null phrase have the number of all words.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    cuts = _cuts(texts, RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    routed = texts.mapInArrow(_route(cuts), "range int, lang string, packed binary")
    counted = saved_once(routed.groupBy("range").applyInArrow(_count(cuts, least), "lang string, words int, phrase string, f long, part boolean"), "phrases")
    parts = counted.where("part").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return counted.where("NOT part").select("lang", "words", "phrase", "f").union(parts.where(f"words = 0 OR f >= {least}"))


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    wide = lambda c: f"cast({c} AS decimal(18, 0))"
    return F.expr(f"(1000000 * ({wide(a)} * {wide(a)})) div ({wide(l)} * {wide(r)})")


def _scored(phrases: DataFrame, counts: DataFrame, words: int, cut: int) -> DataFrame:
    """The phrases with their counts ``l``, ``r`` and ``score`` when cut behind so many words."""
    left = counts.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l")).where(F.col("words") == cut)
    right = counts.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r")).where(F.col("words") == words - cut)
    parts = phrases.select("*", F.substring_index("phrase", " ", cut).alias("_left"), F.substring_index("phrase", " ", cut - words).alias("_right"))
    joined = parts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).drop("_left", "_right")
    return joined.withColumn("score", _score("a", "l", "r"))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, subsumed: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases of two or three words: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``subsumed`` is the per cent of a phrase's occurrences from which a longer phrase around it takes its place.
    """
    counts = saved_once(phrase_counts(docs, least, text_col, lang_col), "phrase-counts")
    of = lambda k: counts.where(F.col("words") == k).select("lang", "phrase", F.col("f").alias("a"))
    pairs, triples = of(2), of(3)
    around = triples.select("lang", F.substring_index("phrase", " ", 2).alias("phrase"), "a").union(triples.select("lang", F.substring_index("phrase", " ", -2).alias("phrase"), "a"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = pairs.join(around, ["lang", "phrase"], "left").where(f"_longer IS NULL OR 100 * _longer < {subsumed} * a").drop("_longer")
    one = _scored(triples, counts, 3, 1)
    two = _scored(triples, counts, 3, 2).select("lang", "phrase", *[F.col(c).alias(f"_{c}") for c in ("l", "r", "score")])
    both = one.join(two, ["lang", "phrase"])
    lowest = both.select("lang", "phrase", "a", *[F.when(F.col("score") <= F.col("_score"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("l", "r", "score")])
    scored = _scored(kept, counts, 2, 1).unionByName(lowest)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language's best are among the best of its hashed parts, which no language makes uneven.
    some = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = some.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH pieces AS (
  SELECT row_number() OVER () AS p, * FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)
), words AS (
  SELECT p, lang, unnest(w) AS w, unnest(range(len(w))) AS i
  FROM (SELECT p, lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces)
), starts AS (
  SELECT lang, w AS a, lead(w) OVER (PARTITION BY p ORDER BY i) AS b, lead(w, 2) OVER (PARTITION BY p ORDER BY i) AS c FROM words
), f AS (
  SELECT lang, 1 AS k, a AS phrase, count(*) AS f FROM starts GROUP BY ALL
  UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM starts WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, count(*) FROM starts WHERE c IS NOT NULL GROUP BY ALL
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), halves AS (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, phrase, a, 2, array_to_string(w[:2], ' '), w[3] FROM c WHERE k = 3
), cuts AS (
  SELECT h.lang, h.phrase, h.a, h.cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * h.a * h.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.x JOIN f y ON y.lang = h.lang AND y.phrase = h.y
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[:2], ' ') AS phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:], ' ') AS phrase, a FROM c WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * lowest.a
), total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
