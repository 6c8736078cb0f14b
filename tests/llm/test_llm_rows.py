"""Archives, chat examples, duplicates, search, pages and packing against brute force."""

import collections
import gzip
import hashlib
import io
import itertools
import random

import numpy as np
import oracle
import pyarrow as pa
import pytest
from reasonset.llm import chat, components, html_text, near_dup, packing, queries, topk, warc
from reasonset.session import shared_folder


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, sf_dir, name):
    assert oracle.differences(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.SQL[name]) == []


# Archives


def test_archives_across_files(spark):
    rows = [(1, "u", "x" * 5000, "k"), (2, "u\n", "x" * 5000, "k"), (3, None, None, "k"), (4, "v", "é\r\n\r\nWARC/1.1\r\n" * 300, "k"), (None, "v", "x" * 5000, "k"), (5, "w", "", "k"), (5, "w", "y" * 999, "k"), (6, "q", "y" * 999, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").coalesce(1)
    folder = shared_folder(spark, "warc")
    warc.write_archives(pages, folder, segment_bytes=700, file_records=3)
    found = warc.read_archives(spark, folder).collect()
    assert len(found) == len(rows) and all(r["complete"] for r in found)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in found if r["payload"] == b"" and r["record_type"] == "revisit"} == {(1, "revisit", 2), (None, "revisit", 2)}
    assert next(r for r in found if r["page_id"] == 4)["payload"].decode() == rows[3][2]
    narrow = warc.resolved(warc.read_archives(spark, folder, False)).collect()
    wanted = sorted((r[0] or 0, len((r[2] or "").encode()), hashlib.sha1((r[2] or "").encode()).hexdigest()) for r in rows)
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in narrow) == wanted


def test_archives_of_no_pages(spark):
    folder = shared_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archives(spark, folder).collect() == []


def test_segments_and_framing():
    payload = bytes(range(256)) * 50
    assert warc.dechunked(warc.chunked(payload, 333)) == payload
    assert warc.dechunked(b"5;x=y\r\nabcde\r\n0\r\nTrailer: x\r\n\r\n") == b"abcde"
    assert warc.dechunked(b"5\r\nabc") is None and warc.dechunked(b"zz\r\n") is None and warc.dechunked(b"") is None
    assert warc.joined([(2, 5, b"de"), (1, None, b"abc")]) == b"abcde"
    assert warc.joined([(1, None, b"abc"), (3, 5, b"de")]) is None and warc.joined([(1, None, b"abc"), (2, 6, b"de")]) is None
    records = warc.page_records(1, "u", "x" * 3000, "0", None, 500)
    data = warc.END.encode().join([*records, b""])
    assert [f["warc-type"] for f, _ in warc.parse(io.BytesIO(data))] == ["response"] + ["continuation"] * (len(records) - 1)
    assert list(warc.parse(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(data)))))[0][0]["warc-segment-number"] == "1"


# Chat


def test_escaping_is_reversible():
    random.seed(2)
    parts = [*chat.CONTROL, "\\", "<", "[", "|", "a", "\n", ">", "]"]
    for _ in range(5000):
        text = "".join(random.choices(parts, k=random.randint(0, 9)))
        held = chat.escape(text)
        assert chat.unescape(held) == text
        assert not any(c in held for c in chat.CONTROL)
        assert chat.parse(f"{chat.START}{held}{chat.SAYS}{held}{chat.END}" * 2) == [(text, text)] * 2


def test_prefix_targets(spark):
    turns = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", "yo", "x"), (1, 2, "user", None, "x"), (1, 3, "assistant", "", "x"), (2, 0, "user", "<|end|>", "x"), (None, 0, None, "n", "x"), (3, 1, "assistant", "b", "x"), (3, 1, "assistant", "a", "x"), (3, 1, "assistant", "a", "x"), (3, None, "system", "s", "x"), (4, 0, "assistant", "long " * 50_000, "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, example string")
    rows = chat.examples(df).collect()
    one = sorted((r for r in rows if r["conv_id"] == 1), key=lambda r: r["example"])
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in one] == ["yo", ""]
    assert chat.parse(one[1]["text"]) == [("user", "hi"), ("assistant", "yo"), ("user", ""), ("assistant", "")]
    assert [r["is_last"] for r in one] == [False, True] and one[1]["text"].startswith(one[0]["text"])
    back = {r["conv_id"]: r for r in chat.read_back(chat.examples(df)).collect()}
    assert set(back) == {1, 2, 3, 4, None}
    assert back[3]["n_turns"] == 4 and back[3]["loss_sha256"] == hashlib.sha256(b"aab").hexdigest()
    assert back[2]["turns_sha256"] == hashlib.sha256(b"user\n<|end|>\n").hexdigest() and back[2]["loss_chars"] == 0
    assert back[4]["loss_chars"] == 250_000
    assert chat.read_back(chat.examples(df.limit(0))).collect() == []


# Near duplicates


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.fixture(scope="module")
def family(spark):
    """Copies of two texts with growing changes, a hot group of exact copies, and rows of every odd kind."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [[word() for _ in range(200)] for _ in range(2)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for n in range(1, 15):
            w = list(b)
            for _ in range(n):
                w[rng.randrange(200)] = word()
            texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(150)) for _ in range(30)] + ["same copy of a text with a few words"] * 40 + [None, "", " \n", "one", "one", "two words", "w " * 60_000, "w " * 60_000]
    return [(i, t, "c", "c", "c") for i, t in enumerate(texts)] + [(None, "same copy of a text with a few words", "c", "c", "c"), (0, texts[0], "c", "c", "c")]


SCHEMA = "doc_id long, text string, tid string, class_id string, sig string"


def test_near_duplicates(spark, family):
    docs = spark.createDataFrame(family, SCHEMA).repartition(4)
    found = near_dup.near_duplicates(docs).collect()
    assert len(found) == len(family)
    cls = {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None}
    texts = {r[0]: r[1] for r in family if r[0] is not None}
    with_words = {i: shingles(t) for i, t in texts.items() if t and t.split()}
    missed = []
    for a in with_words:
        for b in with_words:
            if a < b:
                j = len(with_words[a] & with_words[b]) / len(with_words[a] | with_words[b])
                if texts[a] == texts[b]:
                    assert cls[a] == cls[b]
                elif j >= 0.83:
                    missed += [(a, b)] if cls[a] != cls[b] else []
                elif not j:
                    assert cls[a] != cls[b]
    assert missed == []
    assert all(cls[i] == i for i, t in texts.items() if not t or not t.split())
    assert [r["class_id"] for r in found if r["doc_id"] is None] == [min(i for i, t in texts.items() if t and t.startswith("same copy"))]
    left = near_dup.one_of_each(docs)
    kept = [r["doc_id"] for r in left.collect()]
    assert left.columns == docs.columns
    assert collections.Counter(k for k in kept if k is not None) == collections.Counter(set(cls.values()))
    assert kept.count(None) == 1
    assert near_dup.near_duplicates(docs.limit(0)).collect() == []


def test_links_of_texts_whose_samples_agree_little(spark):
    """Of texts just above the threshold that share a band none is lost, however few of their samples agree."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, near = [], []
    for _ in range(500):
        base = [word() for _ in range(80)]
        near += [(len(texts), len(texts) + k) for k in range(1, 6)]
        texts.append(" ".join(base))
        for _ in range(5):
            w = list(base)
            for at in (rng.randrange(10, 70), 2):
                w[at] = word()
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    rarity, sampler = near_dup.word_rarity(docs), near_dup.Sampler()
    sets = [near_dup.weighted_shingles(near_dup.word_hashes(pa.array([t]))[0], rarity) for t in texts]
    prints = [sampler.sample(*x) for x in sets]
    cls = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    missed, seldom, compared = [], 0, 0
    for a, b in near:
        one, two = dict(zip(*map(list, sets[a]))), dict(zip(*map(list, sets[b])))
        shared = sum(min(float(w), float(two[h])) for h, w in one.items() if h in two)
        similarity = shared / (sum(map(float, one.values())) + sum(map(float, two.values())) - shared)
        same = prints[a] == prints[b]
        if similarity >= 0.8001 and same.reshape(near_dup.BANDS, near_dup.ROWS).all(1).any():
            compared, seldom = compared + 1, seldom + (same.mean() < 0.65)
            missed += [(a, b)] if cls[a] != cls[b] else []
    assert compared > 1000
    assert seldom
    assert missed == []


def broadcast_parts(plan):
    """The lines of each broadcast's part of a plan."""
    lines = plan.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            yield "\n".join(itertools.takewhile(lambda x: depth(x) > depth(line), lines[i + 1 :]))


def test_copies_of_keys_are_not_broadcast(spark, family, monkeypatch):
    """What is copied once per salt is larger than Spark takes it for: the driver must not gather it."""
    saved, plans = near_dup.saved_once, []
    monkeypatch.setattr(near_dup, "saved_once", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df, name))
    near_dup.near_duplicates(spark.createDataFrame(family, SCHEMA)).collect()
    assert sum("Generate explode(" in plan for plan in plans) == 3  # members, leaders, mixed buckets
    assert any("BroadcastExchange" in plan for plan in plans)  # of what is as small as it seems
    assert [part for plan in plans for part in broadcast_parts(plan) if "Generate" in part] == []


def test_pipeline_broadcasts_no_copies(spark, family, monkeypatch):
    """In the pipeline's near-duplicate stage only bitmaps and rows that are as many as they seem are broadcast."""
    import corpus_pipeline

    saved, plans = near_dup.saved_once, []
    monkeypatch.setattr(near_dup, "saved_once", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df, name))
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(family, SCHEMA), "")
    plans.append(left._jdf.queryExecution().executedPlan().toString())
    parts = [part for plan in plans for part in broadcast_parts(plan)]
    assert parts and [part for part in parts if "Generate" in part] == []


def test_one_of_each_with_repeated_ids(spark):
    """A row is judged by its own text, whatever other rows have its id."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    copied, alone, family = (" ".join(word() for _ in range(200)) for _ in range(3))
    rows = [(1, copied), (2, copied), (2, alone), (3, family), (3, family + " end"), (4, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [tuple(r) for r in near_dup.one_of_each(docs).collect()]
    assert {(1, copied), (2, alone), (4, ""), (4, None)} <= set(left)
    assert (2, copied) not in left
    assert len([r for r in left if r[0] == 3]) == 1
    assert len(left) == 5


def test_weighted_sampling_estimates_similarity():
    rng = np.random.default_rng(7)
    sampler = near_dup.Sampler(2048)
    shared, left, right = (rng.integers(1 << 63, size=n, dtype=np.uint64) for n in (400, 60, 60))
    weigh = lambda h: (1 + (h % np.uint64(50)).astype(np.float32) / 10).astype(np.float32)
    one, two = np.unique(np.concatenate([shared, left])), np.unique(np.concatenate([shared, right]))
    wanted = weigh(shared).sum() / (weigh(shared).sum() + weigh(left).sum() + weigh(right).sum())
    got = (sampler.sample(one, weigh(one)) == sampler.sample(two, weigh(two))).mean()
    assert abs(got - wanted) < 0.04


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(200)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: top(x) for e in edges for x in e if e[0] != e[1]}


# Search


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)] + [(300, None), (350, [1.0, None] + [0.0] * 6), (400, [float("nan")] * 8), (450, [float("inf")] + [0.0] * 7), (None, [0.1] * 8), (500, [1.0, 2.0]), (501, [0.5, 0.5]), (550, []), (7, [9.0] * 8), (7, [9.0] * 8), (600, [3e5] * 8), (601, [2e14] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", __import__("pyspark").sql.functions.lit("x")).repartition(3)
    found = topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect()
    sound = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wanted = []
    for q, v in sound:
        if q % 50 == 0:
            scored = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in sound if i != q and len(w) == len(v))[:5]
            wanted += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, found)) == sorted(wanted)
    assert topk.top_k(df.limit(0), df.limit(0), 5).collect() == []


def test_top_k_of_many_blocks(spark, monkeypatch):
    """Blocks meet shards in groups, and no copies of blocks go through the driver."""
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (400, 4))
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    found = topk.top_k(df, df.where("vec_id % 2 = 0"), 3)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    scores = x @ x.T
    wanted = [(q, r, i, -s) for q in range(0, 400, 2) for r, (s, i) in enumerate(sorted((-int(scores[q, i]), i) for i in range(400) if i != q)[:3], 1)]
    assert sorted(map(tuple, found.collect())) == wanted
    for tasks, queries, vectors in [(8, 200, 400), (24, 0, 0), (600, 307_000, 15_000_000), (12, 5, 10**9), (1, 10**6, 10**6)]:
        groups, salts = topk.grid(tasks, queries, vectors)
        blocks = max(1, -(-queries // topk.BLOCK))
        assert 1 <= salts <= 4 * tasks and 1 <= groups <= blocks <= groups * topk.GROUP
        assert groups * salts >= min(tasks, blocks)


# Pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>a &lt;b&gt; &amp; c &#233; &nbsp; d", "a <b> & c é d"),
        ("<body><nav>menu</nav><article><h1>T</h1><p><b>x</b>y<br>z<p>w</article><footer>f</footer>", "T xy z w"),
        ("<div class='sidebar'>s</div><div id=content><p>one two three four five</p><p>six seven eight</p></div><div class='comments'><p>me too me too me too</p></div>", "one two three four five six seven eight"),
        ("<script>if (a<b) {'</p>'}</script><style>p{}</style><article><p>k</p><form>f<input></form><aside>n</aside><p>l</p></article>", "k l"),
        ("<article><p>cut of<!-- never closed", "cut of"),
        ("<article><p>cut <a href='x", "cut"),
        ("<main><section><p>a a a</p></section><section><p>b b b b b b b b</p></section></main>", "a a a b b b b b b b b"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_deep_and_odd_pages(spark):
    assert html_text.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert html_text.main_text("<" * 5000).strip("<") == ""
    rows = [(1, "u", None, "c"), (1, None, "<p>x y</p>", "c"), (None, "u", "<p>x y</p>", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_text.extract(df).collect()) == [(0, "x y"), (1, ""), (1, "x y")]
    assert html_text.extract(df.limit(0)).collect() == []


# Packing


def plain_best_fit(rows, capacity):
    bins, out = [], []  # left, sources, clusters, and whether a full piece closed the bin
    for length, source, cluster in rows:
        pieces = []
        for piece in range(length // capacity):
            pieces.append((piece, len(bins), 0, capacity))
            bins.append([0, {source}, {cluster}, True])
        rest = length % capacity
        if rest or not pieces:
            fit = [(b[0], k) for k, b in enumerate(bins) if not b[3] and b[0] >= rest and not b[1] & {source} - {None} and not b[2] & {cluster} - {None}]
            k = min(fit)[1] if fit else len(bins)
            if not fit:
                bins.append([capacity, set(), set(), False])
            pieces.append((len(pieces), k, capacity - bins[k][0], rest))
            bins[k][0] -= rest
            bins[k][1].add(source)
            bins[k][2].add(cluster)
        out.append(pieces)
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(4)
    for _ in range(60):
        rows = sorted(((rng.choice([0, 1, 30, 50, 60, 99, 100, 250, rng.randrange(100)]), rng.choice([None, 1, 1, 2, 3]), rng.choice([None, 5, 6, 7, 8])) for _ in range(40)), key=lambda r: -r[0])
        assert packing.best_fit(rows, 100) == plain_best_fit(rows, 100)


def test_pack(spark):
    rows = [(i, "x" * (i * 37 % 900), "hot" if i % 3 else f"s{i % 7}", "c") for i in range(400)] + [(1, None, None, "c"), (1, None, None, "c"), (None, "abc", "hot", "c"), (500, "y" * 5000, "hot", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bin string").repartition(3)
    found = packing.pack(df, capacity=1000, group_rows=100).collect()
    assert sum(r["length"] for r in found) == sum(len(r[1] or "") for r in rows)
    assert len({(r["doc_id"], r["piece"]) for r in found if r["doc_id"] == 500}) == 5
    sources = {r[0]: r[2] for r in rows}
    bins = collections.defaultdict(list)
    for r in found:
        bins[r["bin_group"], r["bin"]].append(r)
    for held in bins.values():
        assert sum(r["length"] for r in held) <= 1000
        named = [sources[r["doc_id"]] for r in held if r["doc_id"] not in (1, None) and sources[r["doc_id"]]]
        assert len(named) == len(set(named))
    assert packing.pack(df.limit(0)).collect() == []


# Pipeline


def test_packing_keeps_near_duplicates_apart(spark, family, tmp_path):
    rows = [(*r[:2], f"source {n}") for n, r in enumerate(family)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cls = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    placed = packing.op8_packing(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in placed if not r["piece"]) == collections.Counter(r[0] for r in rows)
    empty = {r[0] for r in rows if not r[1]}
    held = collections.Counter((r["bin_group"], r["bin"], cls[r["doc_id"]]) for r in placed if r["doc_id"] not in empty)
    assert set(held.values()) == {1}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    prose = "the {0} of {1} and the {2} is in a {3} that was {4} with it for {5} on {6}"
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = [" ".join(prose.format(*[word() for _ in range(7)]) for _ in range(4)) for _ in range(20)]
    texts += [texts[0], texts[1] + " end", "### %%% $$$ " * 20, None, "", "mail me at a.b@c.de please " + texts[2][:0] + " ".join(prose.format(*[word() for _ in range(7)]) for _ in range(3))]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kinds = docs.dtypes
    seen = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.dtypes == kinds
        seen.append({r["doc_id"] for r in docs.collect()})
    assert seen[0] == {*range(22), 25} and seen[1] == {*range(20), 25} and seen[2] == seen[1]
    mailed = docs.where("doc_id = 25").first()
    assert "<EMAIL>" in mailed["text"] and mailed["n_chars"] == len(mailed["text"])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == seen[2]
    assert packed.agg(F.sum("length")).first()[0] == sum(len(r["text"].encode()) for r in docs.collect())
