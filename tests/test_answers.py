"""Edit scripts, responses to one input, and mixtures, against plain implementations."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from reasonset.functions import diff
from reasonset.operators import answers, mixtures


def common(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[j]))
        rows.append(row)
    return rows[-1][-1]


@pytest.fixture(scope="module")
def scripts(spark):
    rng = random.Random(0)
    pairs = [(None, "q"), ("q\n", None), (None, None), ("", ""), ("same\n", "same\n"), ("a b c\nx y\n", "a c c\nx y\nz"), (" a", "a "), ("\\n x\n", "\n\\n x"), ("\r\n\t é\x0b", "é \x0b"), ("one\ntwo\nthree\n", "three\none\n")]
    for _ in range(150):
        pairs.append(tuple(" ".join(rng.choices("abcde", k=rng.randint(0, 12))) for _ in range(2)))
    for _ in range(40):
        pairs.append(tuple("".join(rng.choice("ab \n") for _ in range(rng.randint(0, 30))) for _ in range(2)))
    long = ["".join(rng.choices("abcdef", k=3)) for _ in range(400)]
    pairs.append((" ".join(long), " ".join(w for w in long if rng.random() > 0.1)))
    lines = [" ".join(rng.choices(long, k=8)) for _ in range(500)]
    changed = [line if rng.random() > 0.05 else line.replace(line.split()[2], "new", 1) for line in lines if rng.random() > 0.02]
    pairs.append(("\n".join(lines), "\n".join(changed)))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").repartition(8)
    script = diff.text_script(F.col("a"), F.col("b"))
    columns = [diff.applied(F.col("s"), diff.DELETE).alias("left"), diff.applied(F.col("s"), diff.INSERT).alias("right"), diff.words_of(F.col("s"), diff.KEEP).alias("kept"), diff.shown(F.col("s")).alias("shown")]
    return pairs, {r["i"]: r for r in df.select("i", script.alias("s")).select("i", "s", *columns).collect()}


def test_scripts_give_both_texts(scripts):
    pairs, found = scripts
    for i, (a, b) in enumerate(pairs):
        assert (found[i]["left"], found[i]["right"]) == (a or "", b or "")
        assert all(e["op"] in "=-+" and e["text"] for e in found[i]["s"])


def test_scripts_keep_a_longest_subsequence(scripts):
    pairs, found = scripts
    for i, (a, b) in enumerate(pairs[10:160], 10):
        words = [re.findall(diff.WORDS, t) for t in (a, b)]
        if a and b and a != b:
            assert sum(e["op"] == "=" for e in found[i]["s"]) == common(*words)


def test_scripts_go_from_lines_to_words(scripts):
    _, found = scripts
    assert found[5]["shown"] == "=a \n-b \n+c \n=c\\n\n=x y\\n\n+z"
    assert found[4]["shown"] == "=same\\n" and found[2]["shown"] == found[3]["shown"] == ""
    long = found[len(found) - 1]["s"]
    assert sum(e["text"].endswith("\n") and e["op"] == "=" for e in long) > 450 and any(e["text"] == "new " for e in long)


def test_diff_needs_no_python(spark):
    df = spark.createDataFrame([(1, "a"), (None, "n")], "k int, text string")
    found = answers.answer_diff(df, df.withColumn("text", F.concat("text", F.lit(" b"))), ["k"])
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["words_kept"], r["words_deleted"], r["words_inserted"]) for r in found.collect()) == [(0, 1, 2), (0, 1, 2)]


def test_groups_of_odd_inputs(spark):
    rows = [(1, None, "a"), (2, None, "a"), (3, "", "a"), (4, "x", None), (5, "x", ""), (6, "x", ""), (7, "x", "long " * 50_000)]
    df = spark.createDataFrame(rows, "id long, input string, response string")
    found = {r["id"]: tuple(r)[1:] for r in answers.same_input_groups(df).drop("response_no").collect()}
    assert found == {1: (1, 2, 1, 1, 2, True), 2: (1, 2, 1, 1, 2, False), 3: (3, 1, 0, 1, 1, True), 4: (4, 4, 3, 3, 1, True), 5: (4, 4, 3, 3, 2, True), 6: (4, 4, 3, 3, 2, False), 7: (4, 4, 3, 3, 1, True)}
    assert sorted(r["id"] for r in answers.sampled_inputs(df).collect()) == [4, 5, 7]
    assert answers.same_input_groups(df.limit(0)).collect() == []


def test_numbers_of_a_hot_input(spark):
    """No window of one input: its responses are numbered in ranges of their digests."""
    df = spark.range(3000).selectExpr("id", "'hot' AS input", "cast(id % 1000 AS string) AS response")
    found = answers.same_input_groups(df)
    windows = found._jdf.queryExecution().optimizedPlan().toString().split("row_number() windowspecdefinition(")[1:]
    assert windows and all(w.startswith("_bucket") for w in windows)
    rows = found.collect()
    assert {r["response_no"] for r in rows} == set(range(1000)) and {r["copies"] for r in rows} == {3} and sum(r["is_first"] for r in rows) == 1000


def shared(total, sources):
    """Quotas by rounds of exact fractions: {source: (weight, rows)}."""
    dry = {}
    while True:
        rest, open_ = total - sum(dry.values()), {s: w for s, (w, _) in sources.items() if s not in dry}
        shares = {s: Fraction(rest * w, sum(open_.values())) for s, w in open_.items()}
        more = {s: sources[s][1] for s, share in shares.items() if share >= sources[s][1]}
        if not more:
            break
        dry.update(more)
    quotas = {s: int(share) for s, share in shares.items()}
    missing = total - sum(dry.values()) - sum(quotas.values()) if shares else 0
    for s in sorted(shares, key=lambda s: (quotas[s] - shares[s], s))[:missing]:
        quotas[s] += 1
    return {s: q for s, q in {**dry, **quotas}.items() if q}


def test_quotas(spark):
    rng = random.Random(1)
    cases, rows, available = {}, [], {f"s{i}": rng.choice([0, 1, 3, 50, 1000, 10**12]) for i in range(12)}
    for m in range(60):
        chosen = {s: (rng.choice([1, 1, 2, 7, 10**6]), available[s]) for s in rng.sample(sorted(available), rng.randint(1, 12))}
        total = rng.choice([1, 5, 100, 2000, 10**11 + 7])
        cases[m] = (total, {s: x for s, x in chosen.items() if x[1]})
        rows += [(m, s, w, total) for s, (w, _) in chosen.items()]
    rows += [(0, None, 5, 1), (0, "unknown", 5, cases[0][0]), (0, "s1", 0, 1)]
    got = mixtures.mixture_quotas(spark.createDataFrame(rows, "mixture int, source string, weight long, total long"), spark.createDataFrame(list(available.items()), "source string, rows long")).collect()
    for m, (total, sources) in cases.items():
        found = {r["source"]: r["quota"] for r in got if r["mixture"] == m}
        assert found == shared(total, sources)
        assert sum(found.values()) == min(total, sum(n for _, n in sources.values()))


def test_mixtures_read_their_rows_once(spark):
    df = spark.range(1000).selectExpr("id", "concat('s', id % 3) AS source", "repeat('x', 10) AS text")
    wanted = spark.createDataFrame([(1, "s0", 1, 10), (1, "s1", 1, 10), (2, "s0", 1, 4), (3, "s2", 1, 0)], "mixture int, source string, weight long, total long")
    found = mixtures.source_mixtures(df, wanted)
    assert sorted((r["mixture"], r["id"]) for r in found.collect()) == [(1, i) for i in (0, 1, 3, 4, 6, 7, 9, 10, 12, 13)] + [(2, i) for i in (0, 3, 6, 9)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 1000") == 1
