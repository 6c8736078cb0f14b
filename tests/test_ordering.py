"""Splits, curricula and batches: sizes, permutations and carry-over."""

import pytest
from pyspark.sql import functions as F

from reasonset.operators import ordering
from reasonset.plans.training import training_plan


def train(spark, n=503):
    return spark.createDataFrame([(i * 3, 6 + i % 5 if i % 3 else 6) for i in range(n)], "id bigint, difficulty int")


@pytest.mark.parametrize("n", [0, 1, 9, 10, 503])
def test_split_is_exact(spark, n):
    df = train(spark, n)
    parts = [ordering.train_test_split(d) for d in (df, df.repartition(1), df.repartition(7))]
    keys = [[{r["id"] for r in part.collect()} for part in pair] for pair in parts]
    for first, second in keys:
        assert (len(first), len(second)) == (int(0.9 * n), n - int(0.9 * n))
        assert not first & second
    assert keys[0] == keys[1] == keys[2]


@pytest.mark.parametrize("mode", ["none", "easy_to_hard", "first_epoch_only", "grouped_shuffle"])
@pytest.mark.parametrize("epochs", [1, 3])
def test_curriculum_is_a_permutation(spark, mode, epochs):
    df = train(spark)
    rows = ordering.curriculum(df, mode, epochs).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(503 * epochs))
    assert sorted((r["id"], r["epoch"]) for r in rows) == sorted((i * 3, e) for i in range(503) for e in range(epochs))
    first = rows[:503]
    ordered = sorted(first, key=lambda r: (r["difficulty"], r["id"]))
    if mode == "none":
        assert [r["id"] for r in rows] == [i * 3 for i in range(503)] * epochs
    elif mode == "easy_to_hard":
        assert [r["id"] for r in rows] == [r["id"] for r in ordered] * epochs
    elif mode == "first_epoch_only":
        assert first == ordered and [r["epoch"] for r in rows] == sorted(r["epoch"] for r in rows)
        if epochs > 1:
            second, third = ([r["id"] for r in rows[503 * e : 503 * (e + 1)]] for e in (1, 2))
            assert second != third and second != sorted(second)
    else:
        assert [r["difficulty"] for r in rows] == sorted(r["difficulty"] for r in rows)


def test_curriculum_needs_difficulties(spark):
    df = spark.createDataFrame([(1, 6), (2, None)], "id bigint, difficulty int")
    for mode in ("easy_to_hard", "first_epoch_only", "grouped_shuffle"):
        with pytest.raises(Exception, match="difficulty"):
            ordering.curriculum(df, mode, 2).collect()
    with pytest.raises(ValueError, match="difficulty"):
        ordering.curriculum(df.drop("difficulty"), "easy_to_hard", 2)
    with pytest.raises(ValueError, match="unknown"):
        ordering.curriculum(df, "other", 2)
    assert ordering.curriculum(df, "none", 2).count() == 4


def test_batches_carry_over(spark):
    df = train(spark, 10)
    placed = ordering.curriculum(df, "none", 3)
    rows = ordering.assign_batches(placed, 10, 4, 3).orderBy("position").collect()
    # Two steps per epoch, six in all: positions 0..23 of 30 are used.
    assert [r["position"] for r in rows] == list(range(24))
    assert [r["step"] for r in rows] == [p // 4 for p in range(24)]
    assert [r["logged_epoch"] for r in rows] == [p // 4 // 2 for p in range(24)]
    assert rows[8]["epoch"] == 0 and rows[8]["logged_epoch"] == 1
    assert rows[-1]["progress"] == 1.0


def test_fewer_rows_than_a_batch(spark):
    placed = ordering.curriculum(train(spark, 3), "none", 2)
    assert ordering.assign_batches(placed, 3, 4, 2).count() == 0


def test_training_plan(spark):
    rows = training_plan(train(spark), mode="easy_to_hard", epochs=2, batch_size=32).collect()
    steps = int(0.9 * 503) // 32 * 2
    assert len(rows) == steps * 32
    assert {r["step"] for r in rows} == set(range(steps))
    assert max(r["learning_rate"] for r in rows) == pytest.approx(1e-5)


def test_check_difficulty(spark):
    from reasonset.operators.predicates import check_difficulty

    df = spark.createDataFrame([(i, None if i % 2 else float("nan") if i == 0 else 1.0) for i in range(20)],
                               "id bigint, difficulty double")
    assert [tuple(r) for r in check_difficulty(df).collect()] == [(i, 11) for i in (0, 1, 3, 5, 7)]
    assert check_difficulty(df.filter("difficulty = 1")).count() == 0


def test_repeat_no_epochs(spark):
    assert ordering.repeat_epochs(train(spark, 3), 0).count() == 0
    assert ordering.repeat_epochs(train(spark, 3), 2).groupBy("epoch").count().agg(F.min("count")).first()[0] == 3
