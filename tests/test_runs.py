"""Run comparison, step diffs, scoring and metrics on literal results."""

import pytest
from pyspark.sql import functions as F

from reasonset.operators import metrics, rewards, runs, scoring


def samples(spark, rows):
    return spark.createDataFrame(
        rows, "step int, run string, problem bigint, sample_idx int, is_correct boolean, response string, answer string"
    )


def compared(spark, rows):
    found = runs.compare_runs(runs.digested_results(samples(spark, rows)))
    return {(r["step"], r["problem"]): r for r in found.collect()}


def test_compare_runs(spark):
    found = compared(spark, [
        (0, "r1", 1, 0, True, "t", "A"), (0, "r2", 1, 0, False, "t", "A"),
        (0, "r1", 2, 0, True, "t", "A"), (0, "r2", 2, 0, True, "u", "B"),
        (0, "r1", 3, 0, False, "t", None), (0, "r2", 3, 0, None, None, None),
        (0, "r1", 4, 0, True, "t", "A"), (0, "r2", 4, 0, True, "t", "A"),
        (0, "r1", 5, 0, True, "t", "A"),
        (0, "r2", 6, 0, True, "t", "A"), (0, "r3", 6, 0, False, "t", "A"),
        # A later sample makes both correct, but the first texts are the same.
        (0, "r1", 7, 0, False, "t", "A"), (0, "r1", 7, 1, True, "v", "C"), (0, "r2", 7, 0, True, "t", "A"),
        (5, "r1", 1, 0, True, "t", "A"),
    ])
    assert {k: r["category"] for k, r in found.items()} == {
        (0, 1): "flip", (0, 2): "same_passed", (0, 3): "same_failed", (0, 4): "identical", (0, 7): "identical",
    }
    assert found[0, 2]["answers"] == {"r1": "A", "r2": "B"} and found[0, 2]["first_run"] == "r1"
    assert found[0, 3]["answers"] == {"r1": "", "r2": ""}


def test_leaderboard(spark):
    rows = []
    for i in range(8):
        rows.append((0, "r1", i, 0, i < 5, "t", "A"))
        if i != 7:
            rows.append((0, "r2", i, 0, i < 4, "t" if i else "u", "A"))
    rows += [(1, "r1", i, 0, True, "t", "A") for i in range(4)]
    results = runs.digested_results(samples(spark, rows)).withColumn("model", F.concat(F.lit("m"), "step"))
    found = {r["model"]: r for r in runs.determinism_leaderboard(results).collect()}
    # 5/8 = 62.5% and 4/7 = 57.1%; problem 4 flips, problem 0 differs, problem 7 is in one run only.
    assert found["m0"]["accuracy_range"] == "57-62%"
    assert (found["m0"]["outcome_flips"], found["m0"]["identical_pct"], found["m0"]["not_compared"]) == (1, 75.0, 1)
    assert found["m1"]["accuracy_range"] == "N/A" and found["m1"]["identical_pct"] == 100.0
    assert found["m1"]["chart"] == "█" * 50


def results(spark, rows):
    return spark.createDataFrame(rows, "run string, eval string, step bigint, problem bigint, is_correct boolean")


STEPS = [
    ("r", "code", -1, 1, True), ("r", "code", 0, 1, False), ("r", "code", 0, 2, True), ("r", "choice", 5, 1, True),
    ("r", "code", 10, 1, True), ("r", "code", 20, 1, True), ("r", "code", 20, 2, None), ("r", "code", 30, 2, True),
]


def test_step_diff(spark):
    diffed = runs.step_diff(results(spark, STEPS))
    found = {(r["eval"], r["step"], r["problem"]): (r["prev_step"], r["diff"]) for r in diffed.collect()}
    assert found == {
        ("code", -1, 1): (None, None), ("code", 0, 1): (-1, "new_fail"), ("code", 0, 2): (-1, "new"),
        ("choice", 5, 1): (0, None),
        # The step before 10 is 5, which has no code results.
        ("code", 10, 1): (5, None), ("code", 20, 1): (10, "same"), ("code", 20, 2): (10, "new"),
        ("code", 30, 2): (20, "new_pass"),
    }
    per_eval = {(r["step"], r["problem"]): r["diff"] for r in runs.step_diff(results(spark, STEPS), True).collect()
                if r["eval"] == "code"}
    assert per_eval[10, 1] == "new_pass"


def test_step_header(spark):
    diffed = runs.step_diff(results(spark, STEPS))
    found = {(r["eval"], r["step"]): r for r in runs.step_header(diffed).collect()}
    assert (found["code", 0]["total"], found["code", 0]["correct"], found["code", 0]["delta_correct"]) == (2, 1, 0)
    assert found["code", 0]["newly_failed"] == 1 and found["code", 10]["delta_correct"] is None
    legacy = {(r["eval"], r["step"]): r for r in runs.step_header(diffed, legacy_zero=True).collect()}
    assert legacy["code", 10]["delta_correct"] == 1 and legacy["code", 10]["delta_accuracy"] == 1.0
    assert legacy["code", -1]["delta_correct"] is None


def test_filter_results(spark):
    diffed = runs.step_diff(results(spark, STEPS))
    counts = {m: runs.filter_results(diffed, m).count()
              for m in ("all", "correct", "incorrect", "newly_solved", "newly_failed")}
    assert counts == {"all": 8, "correct": 6, "incorrect": 2, "newly_solved": 1, "newly_failed": 1}


def test_scoring(spark):
    problems = spark.createDataFrame([(1,), (2,), (3,)], "problem bigint")
    answered = spark.createDataFrame(
        [("r", 1, False), ("r", 1, True), ("r", 2, False), ("r", 9, True)], "run string, problem bigint, is_correct boolean"
    )
    attached = scoring.attach_samples(problems, answered).groupBy("problem").agg(
        F.count("*").alias("n"), F.bool_or("is_correct").alias("ok"), F.max("error").alias("e")
    )
    assert sorted(map(tuple, attached.collect())) == [(1, 2, True, ""), (2, 1, False, ""), (3, 1, False, "No response")]
    assert scoring.attach_samples(problems, answered, missing="skip").count() == 3
    row = scoring.accuracy(problems, answered, ["run"]).first()
    assert (row["n_correct"], row["n_answered"], row["n_problems"], row["accuracy"]) == (1, 2, 3, pytest.approx(1 / 3))
    assert tuple(scoring.accuracy(problems.limit(0), answered, ["run"]).first()) == ("r", 0, 0, 0, 0.0)
    outside = spark.createDataFrame([("s", 9, True)], "run string, problem bigint, is_correct boolean")
    assert tuple(scoring.accuracy(problems, outside, ["run"]).first()) == ("s", 0, 0, 3, 0.0)
    failed = answered.withColumn("error", F.when(F.col("problem") == 2, "No code found"))
    errors = scoring.attach_samples(problems, failed, k=4).groupBy("problem").agg(F.count("*").alias("n"), F.max("error").alias("e"))
    assert sorted(map(tuple, errors.collect())) == [(1, 2, ""), (2, 1, "No code found"), (3, 4, "No response")]


def test_verdict_where_sample_numbers_restart(spark):
    tests = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1), ("q", 2)], "problem string, test int")
    taken = spark.createDataFrame([("p", 0), ("q", 0)], "problem string, sample int")
    rows = spark.createDataFrame([("p", 0, 1, True), ("p", 0, 2, False), ("q", 0, 1, False), ("q", 0, 2, True)], "problem string, sample int, test int, passed boolean")
    found = scoring.sample_verdict(taken, tests, rows).collect()
    assert {(r["problem"], r["n_passed"], r["is_correct"]) for r in found} == {("p", 1, False), ("q", 1, False)}


def test_late_null_changes_nothing(spark):
    from reasonset.operators.metrics import merge_metrics

    kind = "run string, step int, metric string, value double, seq int"
    base, late = spark.createDataFrame([("r", 0, "a", 1.0, 1)], kind), spark.createDataFrame([("r", 0, "a", None, 2)], kind)
    assert merge_metrics(base, late).first()["value"] == 1.0


def test_results_without_samples_differ_from_an_answer(spark):
    rows = [("a", "r1", 1, None, "", False), ("a", "r2", 1, 0, "abc", False)]
    samples = spark.createDataFrame(rows, "step string, run string, problem int, sample_idx long, response string, is_correct boolean").withColumn("answer", F.lit(""))
    assert [r["category"] for r in runs.compare_runs(runs.digested_results(samples)).collect()] == ["same_failed"]


def test_verdict(spark):
    tests = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "problem string, test int")
    taken = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("q", "d"), ("z", "e")], "problem string, sample string")
    rows = [("p", "a", 1, True), ("p", "a", 2, True), ("p", "b", 1, True), ("p", "c", 1, True), ("p", "c", 2, False),
            ("q", "d", 1, True), ("q", "d", 2, False)]
    found = scoring.sample_verdict(taken, tests, spark.createDataFrame(rows, "problem string, sample string, test int, passed boolean"))
    assert {r["sample"]: r["is_correct"] for r in found.collect()} == {"a": True, "b": False, "c": False, "d": True, "e": True}


def test_rewards(spark):
    rows = [(1, 1.0), (1, 0.0), (2, 1.0), (2, 1.0), (3, 0.0)] + [(4, float(i % 3 == 0)) for i in range(100)]
    df = spark.createDataFrame(rows, "question int, reward double")
    found = rewards.group_advantage(df)
    assert sorted({r["question"] for r in found.collect()}) == [1, 4]
    assert found.agg(F.sum("advantage")).first()[0] == pytest.approx(0)
    assert rewards.batch_reward(df).first()["batch_reward"] == pytest.approx((0.5 + 1 + 0 + 0.34) / 4)
    assert rewards.reward_stats(df.limit(1)).first()["std_reward"] is None


def test_nll(spark):
    df = spark.createDataFrame([([-1.0, -2.0], [0.0, 1.0]), ([-4.0], [1.0])], "logprobs array<double>, weights array<double>")
    assert scoring.mean_nll(df).first()["nll"] == 3.0
    assert scoring.mean_nll(df.limit(0)).first()["nll"] is None


def test_metrics(spark):
    schema = "run string, step int, metric string, value double, seq int"
    base = spark.createDataFrame([("r", 0, "A/Accuracy", 0.1, 9), ("r", 0, "nll", 2.0, 1), ("r", 1, "nll", 3.0, 2)], schema)
    late = spark.createDataFrame([("r", 0, "A/Accuracy", 0.3, 3), ("r", 0, "A/Accuracy", 0.2, 2), ("r", 2, "accuracy", 0.5, 1)], schema)
    merged = metrics.merge_metrics(base, late)
    assert sorted(map(tuple, merged.collect())) == [
        ("r", 0, "A/Accuracy", 0.3), ("r", 0, "nll", 2.0), ("r", 1, "nll", 3.0), ("r", 2, "accuracy", 0.5),
    ]
    assert sorted(map(tuple, metrics.mean_metric(merged).collect())) == [("r", 0, 0.3), ("r", 2, 0.5)]
