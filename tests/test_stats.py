"""Statistics of every choice against filtering first and counting afterwards."""

from pyspark.sql import functions as F

from reasonset.operators import stats
from reasonset.operators.predicates import corpus_filter

ROWS = [
    (1, "a", "x", 6), (2, "a", "x", 6), (3, "a", "y", None), (4, "b", "y", None), (5, None, "x", 7),
    (6, "", "", 10), (7, "all", "x", 8), (8, "é", None, 9), (9, "b", "y", None),
]


def corpus(spark):
    return spark.createDataFrame(ROWS, "id bigint, source string, domain string, difficulty int")


def test_options(spark):
    found = stats.filter_options(corpus(spark)).first()
    assert found["sources"] == ["a", "all", "b", "é"] and found["domains"] == ["x", "y"]
    assert (found["difficulty_min"], found["difficulty_max"]) == (6, 10)


def test_cube_equals_filter_then_count(spark):
    df = corpus(spark)
    cube = {(r["source"], r["domain"]): r for r in stats.stats_cube_maps(df).collect()}
    assert set(cube) == {(s, d) for s in ("all", "a", "b", "é") for d in ("all", "x", "y")}
    for (source, domain), found in cube.items():
        rows = df.filter(corpus_filter(source=source, domain=domain))
        direct = rows.agg(
            F.count("*"), F.count_distinct("source"), F.count_distinct("domain"), F.avg("difficulty"),
            F.min("difficulty"), F.max("difficulty"),
        ).first()
        assert tuple(found[m] for m in stats.MEASURES) == tuple(direct)
        for column, missing in (("difficulty", "None"), ("source", "null"), ("domain", "null")):
            expected = {missing if r[0] is None else str(r[0]): r[1] for r in rows.groupBy(column).count().collect()}
            assert found[f"{column}_distribution"] == expected


def test_distributions(spark):
    df = corpus(spark)
    assert [tuple(r) for r in stats.distribution(df, "difficulty").collect()] == [
        (6, 2), (7, 1), (8, 1), (9, 1), (10, 1), (None, 3),
    ]
    assert [tuple(r) for r in stats.distribution(df, "source").collect()] == [
        ("a", 3), ("b", 2), ("", 1), ("all", 1), ("é", 1), (None, 1),
    ]


def test_filters(spark):
    df = corpus(spark)

    def keys(**filters):
        return [r["id"] for r in df.filter(corpus_filter(**filters)).orderBy("id").collect()]

    assert keys(difficulty_min="null", difficulty_max=8) == [3, 4, 9]
    assert keys(difficulty_max=7) == list(range(1, 10))
    assert keys(difficulty_min=0) == [1, 2, 5, 6, 7, 8]
    assert keys(difficulty_min=7, difficulty_max=8) == [5, 7]
    assert keys(source="", domain="all") == list(range(1, 10))
    assert keys(source="o'brien") == []
    assert keys(source="a", domain="x") == [1, 2]


def test_empty_corpus(spark):
    empty = corpus(spark).limit(0)
    assert stats.basic_stats(empty).first()["total_rows"] == 0
    assert [tuple(r)[:3] for r in stats.stats_cube(empty).collect()] == [("all", "all", 0)]
    assert stats.count_matching(empty, F.lit(True)).first()["n"] == 0


def test_lookup_miss(spark):
    assert stats.lookup_stats(stats.stats_cube(corpus(spark)), "zzz", "all").count() == 0


def test_all_statistics_come_from_one_scan(spark, monkeypatch):
    """Measures, distributions, maps and options read the written counts; the table itself is counted once."""
    df = spark.range(300).selectExpr("concat('s', id % 3) AS source", "concat('d', id % 2) AS domain", "id % 4 AS difficulty")
    calls = []
    saved = stats.saved_once
    monkeypatch.setattr(stats, "saved_once", lambda table, name: calls.append(name) or saved(table, name))
    for found in (stats.stats_cube(df), stats.stats_cube_dist(df), stats.stats_cube_maps(df)):
        assert "Range (0, 300" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert calls == ["counts"] * 3
    rows = {(r["source"], r["domain"]): r for r in stats.stats_cube_maps(df).collect()}
    assert rows["all", "all"]["difficulty_distribution"] == {"0": 75, "1": 75, "2": 75, "3": 75} and len(rows) == 12
