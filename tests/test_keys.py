"""Keys as bytes, selection by intervals, and orders over any keys."""

import datetime
import decimal
import math
import random

import pytest
from pyspark.sql import functions as F

from reasonset.functions.keys import key_bytes
from reasonset.operators import corpus, ordering, position
from reasonset.plans.subsets import generate_subset


def encoded(spark, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    keys = df.columns[1:]
    return {r["i"]: bytes(r["k"]) for r in df.select("i", key_bytes(df.schema, keys).alias("k")).collect()}


def low(value):
    """Spark's order of one value: NULL first, NaN last."""
    return (0, 0) if value is None else (2, 0) if isinstance(value, float) and math.isnan(value) else (1, value.encode() if isinstance(value, str) else value)


def check_order(found, rows):
    rank = lambda r: tuple(low(v) for v in r)
    order = sorted(range(len(rows)), key=lambda i: rank(rows[i]))
    for a, b in zip(order, order[1:]):
        assert (found[a] < found[b]) == (rank(rows[a]) < rank(rows[b])) and (found[a] == found[b]) == (rank(rows[a]) == rank(rows[b])), (rows[a], rows[b])


@pytest.mark.parametrize("schema", ["a string, b bigint", "a bigint, b string, c int", "a double", "a float, b boolean", "a decimal(18,4), b smallint", "a date, b timestamp", "a timestamp_ntz"])
def test_order_of(spark, schema):
    rng = random.Random(schema)
    zone = datetime.timezone.utc
    values = {
        "string": [None, "", "a", "a\0", "a\0\0", "a\0b", "a\x01", "aa", "é", "ÿ", "𝄞", "\0", "\0ÿ"],
        "bigint": [None, 0, -1, 1, 2**63 - 1, -(2**63), 255, 256], "int": [None, 0, -5, 2**31 - 1, -(2**31)], "smallint": [None, 3, -3, 300],
        "boolean": [None, True, False],
        "double": [None, 0.0, -0.0, 1.0, -1.0, math.nextafter(1, 2), math.nextafter(1, 0), 1e308, -1e308, 5e-324, -5e-324, 2.2e-308, float("inf"), float("-inf"), float("nan"), 0.1, 8.0, math.nextafter(8, 0), 2.0**-1022, 1 / 3],
        "float": [None, 0.0, 1.5, -1.5, float("inf"), float("nan"), 2.0**-149],
        "decimal(18,4)": [None, *map(decimal.Decimal, ("0.0000", "-0.0001", "99999999999999.9999", "-99999999999999.9999", "1.5000"))],
        "date": [None, datetime.date(1969, 12, 31), datetime.date(1970, 1, 1), datetime.date(2024, 2, 29)],
        "timestamp_ntz": [None, datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), datetime.datetime(1970, 1, 1), datetime.datetime(1970, 1, 1, 0, 0, 0, 1), datetime.datetime(2024, 1, 1, 12, 30), datetime.datetime(1, 1, 1)],
        "timestamp": [None, datetime.datetime(1969, 12, 31, 23, 59, 59, 999999, zone), datetime.datetime(1970, 1, 1, tzinfo=zone), datetime.datetime(2024, 1, 1, tzinfo=zone)],
    }
    kinds = [c.strip().split(" ", 1)[1] for c in schema.replace("(18,4)", "(18;4)").split(",")]
    rows = [tuple(rng.choice(values[k.replace(";", ",")]) for k in kinds) for _ in range(300)]
    if schema == "a double":
        rows += [(rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-300, 300),) for _ in range(500)] + [(2.0**e,) for e in range(-1074, 1024, 13)]
    check_order(encoded(spark, rows, schema), rows)


def test_other_kinds_of_keys_are_refused(spark):
    df = spark.createDataFrame([([1],)], "a array<int>")
    with pytest.raises(TypeError):
        key_bytes(df.schema, ["a"])


@pytest.mark.parametrize("kind", ["dense", "wide", "text", "one"])
def test_selection_by_intervals(spark, kind, monkeypatch):
    monkeypatch.setattr(position, "INTERVAL", 50)
    rng = random.Random(1)
    make = {"dense": lambda i: i, "wide": lambda i: rng.choice([-1, 1]) * 10 ** rng.randint(0, 18) + i, "text": lambda i: "common beginning of all " + "x" * rng.randint(0, 40) + str(i % 900), "one": lambda i: 7}[kind]
    values = [make(i) for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], f"a {'string' if kind == 'text' else 'bigint'}").repartition(6)
    keyed = df.select("a", key_bytes(df.schema, ["a"]).alias("_k"))
    ordered = sorted(values)
    for n in (1, 2500, 5000):
        cut, below, equal = position.nth_key(keyed, n)
        assert cut["a"] == ordered[n - 1] and below == sum(v < cut["a"] for v in values) and equal == values.count(cut["a"])
    assert position.nth_key(keyed, 5001) == (None, 5000, 0)


def test_selection_shuffles_no_rows(spark):
    """For many rows the rows are a filter of the scan; only a few come from a sort, a bounded one."""
    df = spark.range(30_000)
    plan = lambda n: position.first_n(df, n, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(20_000) and "Sort" not in plan(20_000)
    assert "TakeOrderedAndProject" in plan(500)


def corpus_without_id(spark, n=1200):
    rng = random.Random(2)
    rows = [(f"part-{i % 7}", i // 7, "hot" if i % 3 == 0 else f"s{rng.randrange(5)}", rng.choice([None, 1.5, 2.0, float(i)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "file_name string, row_index bigint, source string, difficulty double").repartition(5)


KEY = ("file_name", "row_index")


def test_cuts_and_splits_over_two_keys(spark):
    rows, df = corpus_without_id(spark)
    found = sorted(tuple(r)[:3] for r in corpus.subset_per_source(df, 40, KEY).collect())
    by_source = {}
    for r in sorted(r[:3] for r in rows):
        by_source.setdefault(r[2], []).append(r)
    assert found == sorted(r for group in by_source.values() for r in group[:40])
    train, test = ordering.train_test_split(df, 0.9, 3, KEY)
    parts = [{tuple(r)[:2] for r in part.collect()} for part in (train, test)]
    assert len(parts[0]) == 1080 and len(parts[1]) == 120 and not parts[0] & parts[1]
    assert ordering.subsample(df, 100, 3, KEY).count() == 100


@pytest.mark.parametrize("mode", ["none", "easy_to_hard", "first_epoch_only", "grouped_shuffle"])
def test_curricula_over_two_keys_and_many_difficulties(spark, mode, monkeypatch):
    """Nearly every row has a difficulty of its own: buckets stay as many as the rows ask for."""
    rows, df = corpus_without_id(spark)
    rows, df = [r for r in rows if r[3] is not None], df.where("difficulty IS NOT NULL")
    largest = []
    offsets = position._bucket_offsets
    monkeypatch.setattr(position, "RANGE_ROWS", 100)
    monkeypatch.setattr(position, "_bucket_offsets", lambda *a: largest.append(offsets(*a).count()) or offsets(*a))
    got = ordering.curriculum(df, mode, 2, 5, KEY).collect()
    assert sorted(r["position"] for r in got) == list(range(2 * len(rows)))
    assert max(largest) <= (position.range_count(2 * len(rows)) if mode != "first_epoch_only" else position.range_count(len(rows)) + 4096)
    first = sorted((r["position"], *[r[c] for c in (*KEY, "difficulty")]) for r in got if r["epoch"] == 0)
    key = {"none": lambda r: r[1:3], "easy_to_hard": lambda r: (r[3], *r[1:3]), "first_epoch_only": lambda r: (r[3], *r[1:3]), "grouped_shuffle": lambda r: r[3]}[mode]
    assert first == sorted(first, key=key)


def test_subset_and_browsing_without_an_id(spark, tmp_path):
    said = lambda who, text: {"from": who, "value": text}
    rows = [("f", i, "s1", "math", 3, [said("human", f"question {i}"), said("gpt", f"<think>why</think> answer {i}")]) for i in range(30)]
    df = spark.createDataFrame(rows, "file_name string, row_index bigint, source string, domain string, difficulty int, messages array<map<string,string>>")
    df = df.withColumn("messages", F.transform("messages", lambda m: F.struct(m["from"].alias("role"), m["value"].alias("text"))))
    assert corpus.browse_table(df, KEY).columns[:3] == ["file_name", "row_index", "difficulty"]
    name = generate_subset(df, str(tmp_path), 4096, 5, key=KEY)
    assert name and sorted(r["row_index"] for r in spark.read.parquet(str(next(tmp_path.glob("**/*.parquet")).parent)).collect()) == [0, 1, 2, 3, 4]


def test_sweep_of_many_requests(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice(["a", "a", "b", None]), rng.randrange(100)) for i in range(500)]
    asked = [(r, rng.choice(["a", "b", "c", "all"]), rng.randrange(110), rng.choice([0, 1, 5, 1000])) for r in range(1000)]
    df = spark.createDataFrame(docs, "id long, source string, _total_tokens long")
    requests = spark.createDataFrame(asked, "request long, wanted_source string, max_tokens long, limit long")
    found = corpus.subset_sweep_of(df, requests)
    wanted = {(r, d[0]) for r, s, t, n in asked for d in [d for d in docs if d[2] <= t and s in ("all", d[1])][:n]}
    assert {(r["request"], r["id"]) for r in found.collect()} == wanted
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_sweep_makes_no_more_rows_than_its_requests_take(spark, monkeypatch):
    """Every request has a budget of its own: written are a few rows for each row that a request takes, not the rows of all intervals below it."""
    rng = random.Random(6)
    docs = [(i, "a", rng.randrange(200)) for i in range(2000)]
    asked = [(r, rng.choice(["a", "all"]), r, 4) for r in range(200)]
    written, save = [], position.saved_once
    for module in (corpus, position):
        monkeypatch.setattr(module, "saved_once", lambda df, name: (out := save(df, name), written.append(out.count()))[0])
    found = corpus.subset_sweep_of(
        spark.createDataFrame(docs, "id long, source string, _total_tokens long"),
        spark.createDataFrame(asked, "request long, wanted_source string, max_tokens long, limit long"),
    )
    got = sorted((r["request"], r["id"]) for r in found.collect())
    assert got == sorted((r, d[0]) for r, _, t, n in asked for d in [d for d in docs if d[2] <= t][:n])
    assert max(written) <= max(2 * len(docs), 8 * len(got))


def test_sweep_of_repeated_keys_and_requests(spark):
    """Equal keys are taken together; requests of the same number and limit are cut as one; keys may be texts."""
    rng = random.Random(7)
    docs = [(f"k{rng.randrange(40):02d}", rng.choice(["a", "b"]), rng.randrange(30)) for _ in range(120)]
    asked = [(rng.randrange(25), rng.choice(["a", "b", "all"]), rng.randrange(40), rng.choice([1, 3, 8])) for _ in range(60)]
    found = corpus.subset_sweep_of(
        spark.createDataFrame(docs, "id string, source string, _total_tokens long"),
        spark.createDataFrame(asked, "request long, wanted_source string, max_tokens long, limit long"),
    )
    wanted = []
    for r, n in {(r, n) for r, _, _, n in asked}:
        union = [(d[0], s, t) for q, s, t, m in asked if (q, m) == (r, n) for d in docs if d[2] <= t and s in ("all", d[1])]
        cut = sorted(k for k, _, _ in union)[:n][-1:]
        wanted += [(r, s, t, n, k, d[1]) for k, s, t in union if cut and k <= cut[0] for d in docs if d[0] == k]
    got = [(r["request"], r["wanted_source"], r["max_tokens"], r["limit"], r["id"], r["source"]) for r in found.collect()]
    assert sorted(got) == sorted(wanted)
