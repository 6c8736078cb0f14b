"""Conversation repair, the pivot index and phrase mining against brute force."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from reasonset.llm import phrases, pivot_dup, turn_repair
from reasonset.llm.turn_repair import Costs, Survivors, Turn, fault_of

# Conversation repair


def cheapest(turns, costs):
    """The cheapest (cost, letters) by whole strings per state."""

    def inserted(ways):
        ways = dict(ways)
        for _ in range(4):
            for new, old in itertools.product((turn_repair.USER, turn_repair.ASSISTANT), range(4)):
                if old in turn_repair.FOLLOWS[new] and old in ways:
                    way = (ways[old][0] + costs.insert, ways[old][1] + "I")
                    ways[new] = min(ways.get(new, way), way)
        return ways

    ways = {turn_repair.START: (0, "")}
    for turn in turns:
        out = collections.defaultdict(list)
        extra = costs.truncated if turn.fault == "truncated" else 0
        own = turn_repair.INITIALS.get(turn.role[:1])
        for state, (cost, letters) in inserted(ways).items():
            out[state].append((cost + costs.delete, letters + "D"))
            if turn.fault in ("blank", "duplicate"):
                continue
            if own is not None and state in turn_repair.FOLLOWS[own]:
                out[own].append((cost + costs.keep + extra, letters + "K"))
            for new in (turn_repair.USER, turn_repair.ASSISTANT):
                if state in turn_repair.FOLLOWS[new]:
                    out[new].append((cost + costs.rerole + extra, letters + "R"))
        ways = {state: min(found) for state, found in out.items()}
    ways = inserted(ways)
    return min(ways[s] for s in turn_repair.FINAL if s in ways)


def references_hold(survivors):
    """Every node of the tree counts its children and the survivors that hold it."""
    nodes = {}
    for _, node in survivors.live.values():
        while id(node) not in nodes:
            nodes[id(node)] = node
            if node is survivors.root:
                break
            node = node.parent
    held = collections.Counter(id(n.parent) for n in nodes.values() if n is not survivors.root) + collections.Counter(id(n) for _, n in survivors.live.values())
    return all(n.refs == held[i] for i, n in nodes.items())


def test_repair_is_cheapest_and_least():
    rng = random.Random(1)
    for k in range(3000):
        costs = Costs() if k % 2 else Costs(rng.randint(0, 1), rng.randint(0, 3), rng.randint(0, 4), rng.randint(1, 5), rng.randint(0, 5))
        turns = [Turn(i, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), "x", rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for i in range(rng.randint(0, 14))]
        out = []
        survivors = Survivors(costs, out.append)
        for turn in turns:
            survivors.step(turn)
            assert references_hold(survivors)
        cost = survivors.finish()
        assert (cost, "".join(n.edit for n in out)) == cheapest(turns, costs)
        assert cost == sum(n.cost for n in out) and [n.turn for n in out if n.edit != "I"] == turns
        assert re.fullmatch("(s?(ua)+)?", "".join("-sua"[n.state] for n in out if n.edit != "D"))
    with pytest.raises(ValueError):
        Costs(insert=0)


def test_repair_holds_only_what_is_open():
    rng, out, most = random.Random(2), [], 0
    survivors = Survivors(Costs(), out.append)
    for i in range(20_000):
        survivors.step(Turn(i, rng.choice(["user", "assistant"]), "x", None))
        most = max(most, i + 1 - len(out))
    assert most < 200
    # Only user turns: two sequences stay tied to the end, whole, and are compared in constant time.
    out.clear()
    survivors = Survivors(Costs(), out.append)
    for i in range(20_000):
        survivors.step(Turn(i, "user", "x", None))
    survivors.finish()
    assert "".join(n.edit for n in out) == "KR" * 10_000


def test_repair_of_odd_rows(spark):
    rows = [
        (1, None, "user", "hi.", 9), (1, 1, "assistant", "yo!", 9), (1, 5, "user", "hi.", 9), (1, 5, "user", "hi.", 9), (1, 6, None, None, 9), (1, 7, "user", "cut", 9), (1, 8, "assistant", "end?", 9),
        (None, 0, "assistant", "a.", 9), (None, 1, "user", "b.", 9), (2, 0, "user", "", 9), (3, 0, "system", "s.", 9), (4, 0, "user", "x. " * 200_000, 9), (4, 1, "assistant", "\x85.\x0b\t", 9),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key int")
    edits = turn_repair.repair(df)
    found = {r["conv_id"]: r for r in turn_repair.summary(edits).collect()}
    # Keeping the cut turn would cost 5; of the two answers, the letters prefer to delete the earlier.
    assert found[1]["audit"] == "KDDDDDK" and found[1]["cost"] == 10
    assert (found[1]["duplicate"], found[1]["blank"], found[1]["truncated"], found[1]["gaps"], found[1]["illegal"]) == (2, 1, 1, 3, 3)
    assert found[None]["audit"] == "RR" and found[2]["audit"] == "D" and found[3]["audit"] == "D" and found[4]["audit"] == "KK"
    assert found[1]["repaired_sha256"] == hashlib.sha256(b"user:hi.\nassistant:end?").hexdigest()
    assert [r["text"] for r in edits.where("conv_id IS NULL").collect()] == ["a.", "b."]
    assert fault_of(" \t\x0b", True) == "blank" and fault_of("x", True) == "duplicate" and fault_of("x ", False) == "truncated" and fault_of("x. \n", False) is None
    gone = turn_repair.repair(df.selectExpr("*", "conv_id = 2 AS here"), present="here")
    none = {r["conv_id"]: r for r in turn_repair.summary(gone).collect()}
    assert set(none) == {1, 2, 3, 4, None} and none[1]["audit"] == "" and none[1]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert turn_repair.summary(turn_repair.repair(df.limit(0))).collect() == []


def test_repair_of_a_hot_conversation(spark):
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant"]), rng.choice(["a.", "b!", "c", "d?", f"t{i}."])) for i in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(16)
    seen, turns = set(), []
    for _, i, role, text in rows:
        turns.append(Turn(i, role, text, fault_of(text, (role, text) in seen)))
        seen.add((role, text))
    out = []
    survivors = Survivors(Costs(), out.append)
    for turn in turns:
        survivors.step(turn)
    cost = survivors.finish()
    (got,) = turn_repair.summary(turn_repair.repair(df)).collect()
    assert (got["cost"], got["audit"]) == (cost, "".join(n.edit for n in out))
    assert got["duplicate"] == sum(t.fault == "duplicate" for t in turns)


# Pivot index


def brute_links(rows, threshold=0.9):
    ok = [(i, np.array(v, float) / max(map(abs, v))) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, label = [0] * len(rows), list(range(len(rows)))
    root = lambda i: i if label[i] == i else root(label[i])
    for (i, a), (j, b) in itertools.combinations(ok, 2):
        if len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
            links[i] += 1
            links[j] += 1
            label[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, (name, _) in enumerate(rows):
        groups[root(i)].append(name)
    least = [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(rows))]
    return collections.Counter((name, n, c, name == c) for (name, _), n, c in zip(rows, links, least))


def test_index_links_odd_rows(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 8))
    near = [(100 + i, (base[i % 30] + rng.normal(size=8) * 0.1).tolist()) for i in range(120)]
    odd = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1e300, 1e300]), (8, [1e-300, 1e-300]), (9, [1.0]), (10, [-2.0]), (11, [3.0]), (None, [5.0]), (9, [1.0])]
    rows = [(i, v) for i, v in [*near, *odd, *[(300, [1.0, 2.0, 3.0])] * 3, (12, [1.0, 2.0, 3.0])]]
    df = spark.createDataFrame([(i, v, "w", 1) for i, v in rows], "vec_id long, embedding array<double>, weight string, dim int")
    found = collections.Counter(tuple(r) for r in pivot_dup.near_vectors(df).collect())
    assert found == brute_links(rows)
    assert pivot_dup.near_vectors(df.limit(0)).collect() == []


def test_index_splits_long_lists(spark, monkeypatch):
    """One group of 600 near copies and 400 exact ones in tiles of about 64 entries."""
    monkeypatch.setattr(pivot_dup, "BLOCK", 64)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.25).tolist()) for i in range(600)] + [(1000 + i, centre.tolist()) for i in range(400)] + [(2000 + i, rng.normal(size=16).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in pivot_dup.near_vectors(df).collect())
    monkeypatch.setattr(pivot_dup, "BLOCK", 1 << 20)
    assert got == sorted(tuple(r) for r in pivot_dup.near_vectors(df).collect())
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum(1) - 1
    # Many pairs of this wide group are just above 0.9.
    assert sum(r[1] for r in got) >= 0.95 * links.sum() and all(r[1] <= n for r, n in zip(got, links))
    assert len({r[2] for r in got if r[0] < 2000 and r[1]}) == 1


def test_index_recall(spark):
    """Pairs at a cosine of just over 0.9 among random vectors, the hardest there are: at least 0.95 of them."""
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=a.shape)
    z -= (z * a).sum(1, keepdims=True) * a
    b = 0.901 * a + np.sqrt(1 - 0.901**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.vstack([a, b]))], "vec_id long, embedding array<double>")
    found = pivot_dup.near_vectors(df).collect()
    assert sum(r["n_links"] for r in found) >= 0.95 * 6000 and all(r["component_id"] % 3000 == r["vec_id"] % 3000 for r in found)


def test_index_recall_on_embeddings(spark):
    folder = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select vec_id, embedding from '{folder}/embeddings.parquet'").fetchall()
    near = [(v, [x + random.Random(v).gauss(0, 0.02) for x in e]) for v, e in rows[::4]]
    both = rows + [(v + 10_000, e) for v, e in near]
    df = spark.createDataFrame(both, "vec_id long, embedding array<double>")
    x = np.array([e for _, e in both])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    wanted = (x @ x.T >= 0.9).sum() - len(x)
    assert wanted >= 900 and sum(r["n_links"] for r in pivot_dup.near_vectors(df).collect()) >= 0.98 * wanted


# Phrases


def test_quicksort_counts():
    rng = np.random.default_rng(0)
    for n, values, least in [(1, 1, 1), (2000, 6, 5), (5000, 40, 10), (3000, 3, 1), (500, 500, 2)]:
        codes, weights = rng.integers(0, values, (3, n)), rng.integers(1, 4, n)
        codes[2][codes[1] == 0] = 0
        for d, (at, counted) in enumerate(phrases.quicksort_counts(codes, weights, least, [-1, 0, 0])):
            wanted = collections.Counter()
            for i in range(n):
                key = tuple(codes[: d + 1, i].tolist())
                if 0 not in key[1:]:
                    wanted[key] += int(weights[i])
            found = {tuple(codes[: d + 1, i].tolist()): f for i, f in zip(at.tolist(), counted.tolist())}
            assert found == {k: f for k, f in wanted.items() if f >= least}


def brute_collocations(docs, least=10, top=2000, subsumed=50):
    counts, total = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in (1, 2, 3):
                counts.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                part = (lang, words[i : i + size])
                if 100 * a >= subsumed * candidates[part]:
                    gone.add(part)
    per = collections.defaultdict(list)
    for (lang, words), a in candidates.items():
        if (lang, words) not in gone:
            cuts = [(1_000_000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            per[lang].append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, rows in per.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


@pytest.fixture(scope="module")
def speech():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("", "é", "ß1", "𝄞")]
    docs = [(rng.choice(["en", "de", None, "x\t"]), " ".join(rng.choices(words, weights=range(1, 33), k=rng.randint(0, 200)))) for _ in range(150)]
    docs += [("en", "Hot Pair, hot pair; hot\tpair\x0bhot pair hot pair")] * 90 + [(None, None), ("en", ""), ("en", " .,;\n"), ("de", "a" * 70_000 + " b"), ("en", "z " * 50_000), ("\x00", "q w e " * 20)]
    return docs


def test_phrases_against_brute_force(spark, speech, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 700)  # long texts and runs are cut
    rows = [(t, lang, 1, "p") for lang, t in speech]
    df = spark.createDataFrame(rows, "text string, lang string, words int, phrase string").repartition(5)
    found = sorted(tuple(r) for r in phrases.collocations(df, top=50).collect())
    assert found == brute_collocations(speech, top=50)
    assert any(r[2] == "hot pair" for r in found)


def test_phrases_of_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_cuts_divide_a_hot_word(spark):
    """A leading word with most of the suffixes spans several ranges, and its count is still whole."""
    rng = random.Random(5)
    docs = [("en", " ".join(f"the w{rng.randrange(300)}" for _ in range(200))) for _ in range(60)]
    df = spark.createDataFrame([(t, lang) for lang, t in docs], "text string, lang string")
    cuts = phrases._cuts(df.selectExpr("lang", "text"), 16)
    assert sum(cut[0] == b"the" for _, cut in cuts) >= 4
    counts = {r["phrase"]: r["f"] for r in phrases.phrase_counts(df).collect()}
    assert counts["the"] == 12_000 and counts[None] == 24_000


def test_suffixes_survive_packing():
    texts = [b"The cat, the cat sat; the cat sat on\xc3\xa9 it"]
    words, piece = phrases.words_of(texts)
    vocabulary, keys, counts = phrases.suffixes(words, piece, len(words))
    shown = pa.array([b"\n", *[w + b"\n" for w in vocabulary.to_pylist()]], pa.large_binary())
    levels, places, back = phrases.unpack(phrases.pack(shown, keys, counts))
    found = {tuple(levels[d][int(places[d][i])].as_py()[:-1] for d in range(3)): int(n) for i, n in enumerate(back)}
    assert found == {(b"the", b"cat", b""): 1, (b"the", b"cat", b"sat"): 2, (b"cat", b"", b""): 1, (b"cat", b"sat", b""): 1, (b"cat", b"sat", b"on\xc3\xa9"): 1, (b"sat", b"", b""): 1, (b"sat", b"on\xc3\xa9", b"it"): 1, (b"on\xc3\xa9", b"it", b""): 1, (b"it", b"", b""): 1}
    assert counts.sum() == len(words)


def test_one_permutation_signatures():
    """Each bin holds its smallest hash or borrows one; texts of one batch do not touch each other."""
    from reasonset.llm import near_dup, text_classes

    texts = ["a b c d e f g", "", "one two", "a b c d e f g", None, "w " * 3000, " \n"]
    column = pa.array([t or "" for t in texts])
    hashes, text = text_classes.shingle_hashes(*near_dup.word_hashes(column))
    values = text_classes.bins(hashes, text, len(texts))
    keys = text_classes.bands(values)
    assert text_classes._distinct(hashes, text, len(texts)).tolist() == [3, 0, 1, 3, 0, 1, 0]
    for i, t in enumerate(texts):
        own, weights = text_classes.plain_set(pa.array([t or ""]))
        assert sorted(set(hashes[text == i].tolist())) == own.tolist() and set(weights.tolist()) <= {1.0}
        least = {}
        for h in own.tolist():
            at = (h >> 32) * text_classes.BINS >> 32
            least[at] = min(h, least.get(at, h))
        for bin_ in range(text_classes.BINS):
            order = text_classes._ORDER[bin_].tolist()
            assert order[0] == bin_ and sorted(order) == list(range(text_classes.BINS))
            found = next((least[b] for b in order if b in least), int(text_classes._EMPTY))
            assert int(values[i, bin_]) == found
    assert np.array_equal(keys[0], keys[3]) and not (keys[0] == keys[2]).any()
