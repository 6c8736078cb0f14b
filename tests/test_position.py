"""Positions and cuts against a plain sort, with skewed groups, gaps in the keys, and large limits."""

import random

import pytest
from pyspark.sql import functions as F

from reasonset.operators import corpus, ordering, position

KEYS = {
    "dense": lambda n: list(range(n)),
    "sparse": lambda n: [i * i * 1_000_003 for i in range(n)],
    "clustered": lambda n: [*range(n - 1), 10**17],
    "negative": lambda n: list(range(-n // 2, n - n // 2)),
}


def frame(spark, kind, n=3000):
    rng = random.Random(1)
    # A third of all rows share one source and one difficulty.
    rows = [(k, "hot" if rng.random() < 0.34 else f"s{rng.randrange(9)}", 1 if rng.random() < 0.34 else rng.randrange(6))
            for k in KEYS[kind](n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id bigint, source string, difficulty int").repartition(7)


@pytest.mark.parametrize("kind", KEYS)
def test_position(spark, kind):
    rows, df = frame(spark, kind)
    buckets = [F.col("difficulty"), position.range_bucket(df, "id", 50)]
    found = position.with_position(df, [F.col("difficulty"), F.col("id")], buckets).collect()
    expected = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert {r["id"]: r["position"] for r in found} == expected
    by_source = position.with_position(df, [F.col("id")], [position.range_bucket(df, "id")], by=["source"]).collect()
    for source in {r[1] for r in rows}:
        keys = sorted(r[0] for r in rows if r[1] == source)
        assert {r["id"]: r["position"] for r in by_source if r["source"] == source} == {k: i for i, k in enumerate(keys)}


def test_ranges_are_even(spark):
    for kind in KEYS:
        _, df = frame(spark, kind)
        largest = df.groupBy(position.range_bucket(df, "id", 50)).count().agg(F.max("count")).first()[0]
        assert largest <= 3000 / 50 * position.MAX_SPAN_PER_ROW


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("n", [0, 137, 2999, 9999])
def test_first_n(spark, kind, n):
    rows, df = frame(spark, kind)
    assert sorted(r["id"] for r in position.first_n(df, n, "id").collect()) == sorted(r[0] for r in rows)[:n]


@pytest.mark.parametrize("derived", [False, True])
def test_first_n_per_group(spark, derived):
    rows, df = frame(spark, "sparse")
    found = position.first_n(df, 40, "id", by=["source"], derived=derived).collect()
    for source in {r[1] for r in rows}:
        assert sorted(r["id"] for r in found if r["source"] == source) == sorted(r[0] for r in rows if r[1] == source)[:40]


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "id bigint, source string")
    found = position.first_n(df, 3, "id", by=["source"]).collect()
    assert sorted(r["id"] for r in found) == [0, 1, 2, 3, 4, 5]


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, source string")
    assert position.first_n(df, 3, "id").count() == 0
    assert position.first_n(df, 3, "id", by=["source"]).count() == 0


def test_double_keys(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "id double")
    assert sorted(r["id"] for r in position.first_n(df, 77, "id").collect()) == sorted(values)[:77]


def test_deep_pages_join_up(spark):
    rows, df = frame(spark, "sparse")
    pages = [[r["id"] for r in corpus.page(df, p, 900).orderBy("id").collect()] for p in (1, 2, 3, 4, 5)]
    assert sum(pages, []) == sorted(r[0] for r in rows)
    assert [len(p) for p in pages] == [900, 900, 900, 300, 0]


def test_subsample_is_the_start_of_the_seeded_order(spark):
    _, df = frame(spark, "dense")
    order = [r["id"] for r in df.orderBy(position.hash_key(F.col("id"), 42)).collect()]
    assert {r["id"] for r in ordering.subsample(df, 500).collect()} == set(order[:500])
    assert ordering.subsample(df, 10**6).count() == 3000


@pytest.mark.parametrize("n", [9_999, 10_000, 10_001])
@pytest.mark.parametrize("kind", ["null", "repeated", "text", "pair", "hot"])
def test_one_contract_for_every_size(spark, kind, n):
    size = 10_500
    keys = {
        "null": lambda i: (None if i % 3 == 0 else i, 0),
        "repeated": lambda i: (i // 700, 0),
        "text": lambda i: (f"k{i * 7919 % size}", 0),
        "pair": lambda i: (i % 5, None if i % 1000 == 0 else i),
        "hot": lambda i: (5, 0),
    }[kind]
    rows = [(*keys(i), i % 4) for i in range(size)]
    dtype = "string" if kind == "text" else "bigint"
    df = spark.createDataFrame(rows, f"a {dtype}, b bigint, x int").repartition(5)
    found = [(r["a"], r["b"]) for r in ordering.head(df, n, ["a", "b"]).collect()]
    low = lambda v: (v is not None, v if v is not None else 0)
    order = lambda r: (low(r[0]) if kind != "text" else (True, r[0]), low(r[1]))
    assert sorted(found, key=order) == sorted((r[:2] for r in rows), key=order)[:n]
    # The choice among ties depends on the rows alone.
    again = ordering.head(df.repartition(3), n, ["a", "b"])
    assert again.exceptAll(ordering.head(df, n, ["a", "b"])).count() == 0


def test_pages_of_tied_rows_join_up(spark):
    rows = [(i % 2, i) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, x int")
    pages = [corpus.page(df, p, 30).collect() for p in (1, 2, 3, 4, 5)]
    assert [len(p) for p in pages] == [30, 30, 30, 10, 0]
    assert sorted(tuple(r) for p in pages for r in p) == sorted(rows)
    assert [r["id"] for p in pages for r in p] == sorted(r[0] for r in rows)
