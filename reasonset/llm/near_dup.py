"""Near duplicates by improved consistent weighted sampling.

A text is a weighted set: its distinct shingles of five words, each weighing its count in the text times the
mean inverse document frequency of its words. Frequencies are counted over all documents in a table of 2**16
hashed words, whose size never grows. (Frequencies of whole shingles would have to be shuffled one by one,
and would make the very passages that copies share the lightest.)

Consistent weighted sampling draws 64 samples per text, so that two texts agree on a sample with the
probability of their weighted Jaccard similarity. Sixteen bands of four samples give the candidates:

1. Identical texts are one text from here on. What is shuffled about a text is its digest, total weight and
   bands, never its words.
2. In each bucket every member is paired with one leader, picked by a hash that differs from bucket to
   bucket, and the pairs are verified by the exact weighted Jaccard similarity. Verified pairs give classes.
3. Buckets that still hold several classes are compared member by member across classes in blocks of bounded size,
   each pair in the first band that it shares. The texts of members that have someone to be compared with are brought to
   the block and verified there until the block's classes are joined or nothing is left; only links leave the task. So
   every pair that shares a bucket is linked by its class, or compared; a bucket of many copies of one thing costs one
   pair per member.

Pairs are left out before the texts are compared only where they cannot be similar: the similarity of two weighted
sets is at most the lesser total weight over the greater. No estimate from the samples drops a pair, so that what is lost
is what banding loses: sharing no band of sixteen has a probability of 0.0002 at 0.8 and less above.

Defined results: a null text counts as an empty one; texts without words belong to no group; texts of one to
four words are one shingle; identical texts with a word are always in one class; a class id is the smallest document
id of the class; a row with a null id is in the class of its text but names none (its class id is null where no
other row has an id). Repeated rows give repeated rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonset.session import saved_once

from .common import small_batches, table
from .components import components

WORDS, BANDS, ROWS = 5, 16, 4
SAMPLES = BANDS * ROWS
THRESHOLD = 0.8
BUCKETS = 1 << 16
BLOCK, BLOCK_BYTES = 512, 8 << 20
FILTER_WORDS = 1 << 17
SALTS = 16

#: The weighted set of the text in a column of one row: shingles ascending, and their weights.
Vector = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    if len(cache.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, _U)
        steps[0] = 1
        cache[base] = np.cumprod(steps, dtype=_U)
    return cache[base][:n]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a string column, and where each row's words start (one more than rows)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    low, high = int(offsets[0]), int(offsets[-1])
    if high == low or data is None:
        return np.zeros(0, _U), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[low:high]
    offsets = offsets - low
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # no word goes on from one row to the next
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((raw.astype(_U) + _U(1)) * _powers(len(raw), _BASE), dtype=_U)])
    hashes = (sums[ends] - sums[starts]) * _powers(len(raw), _INVERSE)[starts]
    return _mixed(hashes + (ends - starts).astype(_U)), np.searchsorted(starts, offsets)


def weighted_shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of one text in ascending order, and their weights."""
    n = len(words)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.float32)
    rare = idf[(words >> _U(48)).astype(np.int64)]
    if n < WORDS:
        words, rare = np.concatenate([words, np.zeros(WORDS - n, _U)]), np.concatenate([rare, np.full(WORDS - n, rare.mean())])
        n = WORDS
    joined = np.zeros(n - WORDS + 1, _U)
    weight = np.zeros(n - WORDS + 1, np.float64)
    for k in range(WORDS):
        joined = (joined + words[k : n - WORDS + 1 + k]) * _U(0xD6E8FEB86659FD93)
        weight += rare[k : n - WORDS + 1 + k]
    found, first, times = np.unique(_mixed(joined), return_index=True, return_counts=True)
    return found, (weight[first] / WORDS * times).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling with its random numbers in a table.

    For every shingle and sample a table entry chosen by a hash gives r and c (gamma distributed, shape 2) and
    b (uniform). The sample is the shingle with the smallest ``ln c - r (t - b) - r``, where
    ``t = floor(ln weight / r + b)``, together with its t.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 20, entries: int = 1 << 16):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.r = rng.gamma(2, 1, entries).astype(np.float32)
        self.one_r = (1 / self.r).astype(np.float32)
        self.c = np.log(rng.gamma(2, 1, entries)).astype(np.float32)
        self.b = rng.random(entries, np.float32)
        self.odd = rng.integers(1 << 63, size=samples, dtype=_U) * _U(2) + _U(1)
        self.samples = samples

    def sample(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A 64-bit fingerprint per sample."""
        logs = np.round(np.log(weights) * 1024).astype(np.float32) / np.float32(1024)
        best = np.full(self.samples, np.inf, np.float32)
        chosen, ts = np.zeros(self.samples, _U), np.zeros(self.samples, np.int64)
        every = np.arange(self.samples)
        for start in range(0, len(shingles), 512):
            h = shingles[start : start + 512]
            at = ((h[None, :] * self.odd[:, None]) >> _U(48)).astype(np.intp)
            r, b = self.r.take(at), self.b.take(at)
            t = np.floor(logs[None, start : start + 512] * self.one_r.take(at) + b)
            a = self.c.take(at) - r * (t - b) - r
            least = a.argmin(1)
            value = a[every, least]
            better = value < best
            best[better], chosen[better], ts[better] = value[better], h[least][better], t[every, least][better].astype(np.int64)
        return _mixed(chosen + ts.astype(_U) * _U(0xA0761D6478BD642F) + every.astype(_U) * _U(_BASE))


def _bands(fingerprints: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=_U) + _U(1)
    for k in range(ROWS):
        keys = _mixed(keys * _U(_BASE) + fingerprints.reshape(BANDS, ROWS)[:, k])
    return keys


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in small_batches(batches, "text"):
        words, cuts = word_hashes(batch.column(0))
        slots = (words >> _U(48)).astype(np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            counts[np.unique(slots[a:b])] += 1
        rows += batch.num_rows
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"slot": pa.array([*used, -1], pa.int32()), "n": pa.array([*counts[used], rows], pa.int64())})


def word_rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Smoothed inverse document frequency per hashed word, from all documents: a table of fixed size."""
    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_count_words, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    rows = found.toPandas()
    counts = np.zeros(BUCKETS)
    inner = rows[rows.slot >= 0]
    counts[inner.slot.to_numpy()] = inner.n.to_numpy()
    total = int(rows.n[rows.slot < 0].sum())
    return (np.log((1 + total) / (1 + counts)) + 1).astype(np.float32)


def _sign(rarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, idf = Sampler(), rarity.value
        for batch in small_batches(batches, "text"):
            column = batch.column(1)
            words, cuts = word_hashes(column)
            rows = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                shingles, weights = weighted_shingles(words[cuts[i] : cuts[i + 1]], idf)
                if not len(shingles):
                    rows.append((doc_id, None, None, None, None))
                    continue
                prints = sampler.sample(shingles, weights)
                digest = hashlib.md5(column[i].as_buffer(), usedforsecurity=False).digest()
                rows.append((doc_id, digest, float(weights.sum(dtype=np.float64)), _bands(prints).astype(np.int64).tolist(), len(column[i].as_buffer())))
            ids, digests, totals, bands, sizes = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(totals, pa.float64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())],
                ["doc_id", "tid", "weight", "bands", "size"],
            )

    return run


def signatures(docs: DataFrame, rarity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digest of the text (``tid``), total weight, band keys, bytes of the text; all but the id null without words."""
    return _texts(docs, id_col, text_col).mapInArrow(_sign(rarity), "doc_id long, tid binary, weight double, bands array<bigint>, size long")


#: Two weights whose ratio is this much below the threshold by rounding alone are still compared.
_ROUNDING = 1 - 1e-6


def _candidates(members: list[dict], band: int, i: int, j: int, threshold: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Of a block with itself (i = j) or with another: for each place the later places of other classes that share no
    earlier band and whose weights allow the threshold, and the classes of all members."""
    bands = np.array([m["bands"] for m in members], np.int64).reshape(len(members), -1)
    weight = np.array([m["weight"] for m in members])
    block = np.array([m["block"] for m in members])
    names: dict[bytes, int] = {}
    cls = np.array([names.setdefault(m["component"], len(names)) for m in members])
    every, found = np.arange(len(members)), []
    for x in range(len(members)):
        able = np.minimum(weight, weight[x]) >= threshold * _ROUNDING * np.maximum(weight, weight[x])
        others = np.flatnonzero((cls != cls[x]) & ((block > block[x]) if i != j else (every > x)) & able)
        found.append(others[~(bands[others, :band] == bands[x, :band]).any(1)])
    return found, cls


_PLACE = "key long, band int, i int, j int"
_MEMBER = "block int, tid binary, component binary, weight double, bands array<bigint>"


def _comparable(threshold: float):
    """The members of blocks that are to be compared with a member of another class."""
    place = [("key", pa.int64()), ("band", pa.int32()), ("i", pa.int32()), ("j", pa.int32())]
    schema = pa.schema(place + [("block", pa.int32()), ("tid", pa.binary()), ("component", pa.binary()), ("weight", pa.float64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                members = row.pop("members")
                found, _ = _candidates(members, row["band"], row["i"], row["j"], threshold)
                needed = np.unique(np.concatenate([np.append(others, x) for x, others in enumerate(found) if len(others)] or [np.zeros(0, np.int64)]))
                rows += [{**row, **members[k]} for k in needed.tolist()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


class Block:
    """The weighted sets of some texts, laid out so that one is compared with all at once."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.totals = np.array([w.sum(dtype=np.float64) for _, w in vectors])
        self.cuts = np.concatenate([[0], np.cumsum([len(h) for h, _ in vectors])])
        _, self.at = np.unique(np.concatenate([h for h, _ in vectors]), return_inverse=True)
        self.weights = np.concatenate([w for _, w in vectors])
        # A shingle of one text alone is in no intersection.
        shared = np.bincount(self.at)[self.at] > 1
        self.owner = np.repeat(np.arange(len(vectors)), np.diff(self.cuts))[shared]
        self.cuts = np.concatenate([[0], np.cumsum(shared)])[self.cuts]
        self.at, self.weights = self.at[shared], self.weights[shared]
        self.row = np.zeros(int(self.at.max()) + 1 if len(self.at) else 0, np.float32)

    def alike(self, x: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Those of the others whose weighted Jaccard similarity to x reaches the threshold."""
        own = slice(self.cuts[x], self.cuts[x + 1])
        self.row[self.at[own]] = self.weights[own]
        common = np.bincount(self.owner, np.minimum(self.row[self.at], self.weights), len(self.totals))[others]
        self.row[self.at[own]] = 0
        return others[common >= threshold * (self.totals[x] + self.totals[others] - common)]


def _link_blocks(vector: Vector, threshold: float):
    """Links between classes inside blocks of members with their texts: no more than the classes need to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                members = row["members"]
                found, cls = _candidates(members, row["band"], row["i"], row["j"], threshold)
                root = cls.copy()  # per member the class that it has been joined to
                sets = None
                for x, others in enumerate(found):
                    others = others[root[others] != root[x]]
                    if not len(others):
                        continue
                    if sets is None:
                        sets = Block([vector(pa.array([m["text"]])) for m in members])
                    for y in sets.alike(x, others, threshold).tolist():
                        if root[y] != root[x]:
                            root[root == root[y]] = root[x]
                            a.append(members[x]["tid"])
                            b.append(members[y]["tid"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def alike(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], threshold: float) -> bool:
    """Whether the weighted Jaccard similarity of two weighted sets reaches the threshold."""
    (ha, wa), (hb, wb) = one, two
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    shared = float(np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64))
    return shared >= threshold * (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - shared)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _similar(vector: Vector, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[bytes, tuple] = OrderedDict()

        def known(tid: bytes, column: pa.Array, i: int):
            if tid in kept:
                kept.move_to_end(tid)
            else:
                kept[tid] = vector(column.slice(i, 1))
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[tid]

        for batch in batches:
            close = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                close.append(alike(known(a, batch.column(2), i), known(b, batch.column(3), i), threshold))
            yield batch.select([0, 1]).filter(pa.array(close, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, vector: Vector, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    of = lambda side: texts.select(F.col("tid").alias(side), F.col("text").alias(f"text_{side}"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_similar(vector, threshold), "a binary, b binary")


def _slot(*columns):
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_WORDS * 64))


def _bitmap(slots: DataFrame) -> DataFrame:
    """(w, bits): a bitmap of slots ``s`` as at most ``FILTER_WORDS`` numbers of 64 bits."""
    return slots.groupBy(F.floor(F.col("s") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(s, 64) AS int)))").alias("bits"))


def _needed_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(tid, text) of the wanted (tid, doc_id): rows are first sifted in the scan by a bitmap of fixed size.

    The bitmap only spares shuffling; whatever it lets through is joined exactly.
    """
    bitmap = _bitmap(wanted.select(_slot("tid", "doc_id").alias("s")))
    rows = _texts(docs, id_col, text_col).withColumn("tid", F.unhex(F.md5("text"))).withColumn("s", _slot("tid", "doc_id"))
    sifted = rows.join(F.broadcast(bitmap), F.floor(F.col("s") / 64) == F.col("w")).where(F.getbit("bits", F.pmod("s", F.lit(64)).cast("int")) == 1)
    sifted = sifted.select("tid", "doc_id", "text")
    return sifted.join(wanted, sifted.tid.eqNullSafe(wanted.tid) & sifted.doc_id.eqNullSafe(wanted.doc_id), "left_semi").dropDuplicates(["tid"]).select("tid", "text")


def _salted(keys: DataFrame) -> DataFrame:
    """Every row once per salt: the small side of a join with the members of buckets, of which a hot one is read by several tasks.

    Spark takes the copies, and the members, for as small as their rows before they were multiplied; the hint keeps either from being
    gathered by the driver to be broadcast.
    """
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def classes_of(docs: DataFrame, signed: DataFrame, vector: Vector, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """From signatures (``doc_id``, ``tid``, ``weight``, ``bands``, ``size``): the smallest id of each text, and (node, component)
    of the texts with a near duplicate, whose similarity is that of ``vector``."""
    # Identical texts become one, named by its smallest document id.
    firsts = signed.where("tid IS NOT NULL").groupBy("tid").agg(F.min("doc_id").alias("doc_id"))
    unique = signed.where("tid IS NOT NULL").dropDuplicates(["tid", "doc_id"]).join(firsts.withColumnRenamed("doc_id", "first"), "tid").where(F.col("doc_id").eqNullSafe(F.col("first")))
    unique = saved_once(unique.select("tid", "weight", "bands", "size"), "unique")
    # Only fixed-width columns are counted per bucket, and only members of buckets with company go on.
    placed = unique.select("tid", "weight", "size", F.posexplode("bands").alias("band", "key")).withColumn("o", F.xxhash64("tid", "key"))
    shared_keys = placed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("o").alias("least")).where("n > 1")
    salt = F.pmod(F.xxhash64("tid", F.lit(2)), F.lit(SALTS)).cast("int")
    members = saved_once(placed.drop("size").withColumn("salt", salt).join(_salted(shared_keys), ["key", "salt"]), "buckets")
    wanted = firsts.join(members.select("tid").distinct(), "tid", "left_semi")
    texts = saved_once(_needed_texts(docs, wanted, id_col, text_col), "texts")

    leaders = members.where("o = least").groupBy("key").agg(F.min(F.struct(F.col("tid").alias("a"), F.col("weight").alias("weight_a"))).alias("x")).select("key", "x.a", "x.weight_a")
    able = F.least("weight", "weight_a") >= threshold * _ROUNDING * F.greatest("weight", "weight_a")
    pairs = _ordered(members.join(_salted(leaders), ["key", "salt"]).where((F.col("tid") != F.col("a")) & able).select("a", F.col("tid").alias("b")))
    links = saved_once(_verified(pairs, texts, vector, threshold), "links")
    classes = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # Buckets in which several classes meet, block against block.
    named = members.join(classes.withColumnRenamed("node", "tid"), "tid", "left").withColumn("component", F.coalesce("component", "tid"))
    named = saved_once(named.select("key", "salt", "band", "n", "bytes", "tid", "weight", "component"), "named")
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    dealt = named.join(_salted(mixed), ["key", "salt"]).join(unique.select("tid", "bands"), "tid")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("tid", F.lit(1)), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    at = ["key", "band", "i", "j"]
    member = ["block", "tid", "component", "weight", "bands"]
    dealt = dealt.select("key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *member)
    met = dealt.groupBy(*at).agg(F.collect_list(F.struct(*member)).alias("members"))
    comparable = met.mapInArrow(_comparable(threshold), f"{_PLACE}, {_MEMBER}")
    met = comparable.join(texts, "tid").groupBy(*at).agg(F.collect_list(F.struct(*member, "text")).alias("members"))
    more = saved_once(met.mapInArrow(_link_blocks(vector, threshold), "a binary, b binary").distinct(), "links")
    every = links.union(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return firsts, components(every) if more.limit(1).count() else classes


def _linked(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signatures of all rows, the smallest id of each text, and (node, component) of the texts with a near duplicate."""
    rarity = docs.sparkSession.sparkContext.broadcast(word_rarity(docs, text_col))
    signed = saved_once(signatures(docs, rarity, id_col, text_col), "signatures")
    vector = lambda column: weighted_shingles(word_hashes(column)[0], rarity.value)
    return signed, *classes_of(docs, signed, vector, threshold, id_col, text_col)


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """One row per document: ``doc_id``, ``tid``, ``class_id``, and the text (``kept``) of the class's smallest id and digest."""
    signed, firsts, final = _linked(docs, threshold, id_col, text_col)
    named = firsts.join(final.withColumnRenamed("node", "tid"), "tid", "left").select("tid", "doc_id", F.coalesce("component", "tid").alias("component"))
    ids = named.groupBy("component").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tid"))).alias("x"))
    of_text = named.join(ids, "component").select("tid", F.col("x.doc_id").alias("class_id"), F.col("x.tid").alias("kept"))
    rows = signed.select("doc_id", "tid")
    grouped_rows = rows.where("tid IS NOT NULL").join(of_text, "tid").select("doc_id", "tid", "class_id", "kept")
    return grouped_rows.union(rows.where("tid IS NULL").select("doc_id", "tid", F.col("doc_id").alias("class_id"), F.col("tid").alias("kept")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``class_id``."""
    return _classes(docs, threshold, id_col, text_col).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near duplicates: of each class the row with the smallest id stays.

    Rows without an id stay. Repeated rows of the smallest id leave one; of different texts of one class under that
    id the one with the smallest digest stays. Rows of one id whose texts are in different classes are judged one by one.
    """
    classes = saved_once(_classes(docs, threshold, id_col, text_col), "classes")
    gone = classes.where("doc_id <> class_id OR doc_id IS NOT NULL AND tid <> kept").select(F.col("doc_id").alias("__gone"), F.col("tid").alias("__tid")).distinct()
    # A bitmap of fixed size tells in the scan which rows cannot be meant; only the others are shuffled to be sure.
    number = F.col(id_col).cast("long")
    bitmap = _bitmap(gone.select(_slot(F.col("__gone")).alias("s"))).withColumnRenamed("w", "__w").withColumnRenamed("bits", "__bits")
    slot = _slot(number)
    marked = docs.join(F.broadcast(bitmap), F.floor(slot / 64) == F.col("__w"), "left")
    meant = F.coalesce(F.getbit("__bits", F.pmod(slot, F.lit(64)).cast("int")) == 1, F.lit(False))
    clear = marked.where(~meant).select(docs["*"])
    left = clear.unionByName(marked.where(meant).select(docs["*"]).join(gone, (number == F.col("__gone")) & (F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))) == F.col("__tid")), "left_anti"))
    again = classes.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again")
    if not again.limit(1).count():
        return left
    once = left.join(again, F.col(id_col).cast("long") == F.col("__again"), "left_semi").dropDuplicates([id_col, text_col])
    return left.join(again, F.col(id_col).cast("long") == F.col("__again"), "left_anti").unionByName(once)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
