"""Comparison of runs and steps over evaluation results.

Results are in long form: one row per (run, eval, step, problem) with ``is_correct``, and for run
comparison the first sample's ``response`` and extracted ``answer``.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import run_config
from ..functions.text import bar
from ..session import saved_once


def first_result(samples: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """One result per problem: whether any sample is correct, and the first sample's ``columns``.

    The first sample is an aggregate, not a window, and so is found before the shuffle. A sample
    without a number comes first.
    """
    return samples.groupBy(*by).agg(
        F.bool_or(F.coalesce("is_correct", F.lit(False))).alias("is_correct"),
        *[F.min_by(c, F.struct(order)).alias(c) for c in columns],
    )


def digested_results(samples: DataFrame, by: str = "step", order: str = "sample_idx") -> DataFrame:
    """The results that :func:`compare_runs` takes, one per (``by``, run, problem).

    Responses become 128-bit digests where they are read: texts of any length are compared as two
    numbers, without being shuffled.
    """
    response = F.coalesce("response", F.lit(""))
    digests = {"digest1": F.xxhash64(response), "digest2": F.xxhash64(F.lit(1), response)}
    answered = samples.withColumns({**digests, "answer": F.coalesce("answer", F.lit(""))})
    return first_result(answered, [by, "run", "problem"], order, [*digests, "answer"])


def first_runs(samples: DataFrame, by: str = "step") -> DataFrame:
    """The first run by name of each ``by`` value."""
    return samples.groupBy(by).agg(F.min("run").alias("first_run"))


def run_summary(results: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Per run: passed, failed and all problems, and the accuracy."""
    return (
        results.groupBy(*by)
        .agg(F.count_if(F.coalesce("is_correct", F.lit(False))).alias("passed"), F.count(F.lit(1)).alias("total"))
        .withColumn("failed", F.col("total") - F.col("passed"))
        .withColumn("accuracy", F.try_divide(F.col("passed").cast("double"), F.col("total")))
    )


def compare_runs(results: DataFrame, by: str = "step", firsts: DataFrame | None = None) -> DataFrame:
    """Problems of each ``by`` value compared over its runs, in one shuffle.

    Takes :func:`digested_results`, and :func:`first_runs` of the samples where that saves working
    them out of the results.

    The first run by name is the reference: only its problems are compared, and only those that
    at least one other run has. ``category`` is ``flip`` when outcomes differ, ``same_passed`` or
    ``same_failed`` when outcomes agree but texts do not, else ``identical``. ``answers`` maps
    runs to answers.
    """
    firsts = first_runs(results, by) if firsts is None else firsts
    # One row per ``by`` value; once written, its size decides whether it is broadcast.
    firsts = saved_once(firsts.withColumnRenamed(by, "_by"), "first-runs")
    groups = results.groupBy(by, "problem").agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.min("run").alias("_first"),
        F.bool_and("is_correct").alias("_all"),
        F.bool_or("is_correct").alias("_any"),
        (F.min("digest1") != F.max("digest1")).alias("_differ1"),
        (F.min("digest2") != F.max("digest2")).alias("_differ2"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("run", "answer")))).alias("answers"),
    )
    category = (
        F.when(F.col("_all") != F.col("_any"), "flip")
        .when(~F.col("_differ1") & ~F.col("_differ2"), "identical")
        .when(F.col("_all"), "same_passed")
        .otherwise("same_failed")
    )
    compared = groups.filter(F.col("n_runs") >= 2).join(
        firsts, (F.col(by) == F.col("_by")) & (F.col("_first") == F.col("first_run"))
    )
    return compared.select(by, "problem", "n_runs", "first_run", category.alias("category"), "answers")


CATEGORIES = ["flip", "same_passed", "same_failed", "identical"]


def comparison_counts(compared: DataFrame, by: str = "step") -> DataFrame:
    """Problems per category, one column each, and all compared ones."""
    return compared.groupBy(by).agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES], F.count(F.lit(1)).alias("compared")
    )


def determinism_leaderboard(results: DataFrame, by: str = "model", firsts: DataFrame | None = None) -> DataFrame:
    """Per model: range of run accuracies, flips, and the share of identical problems, best first.

    The share is taken over all problems of the first run, so that a problem which no other run
    has counts as identical; ``not_compared`` tells how many those are.
    """
    counts = comparison_counts(compare_runs(results, by, firsts), by)
    percent = F.bround(F.col("accuracy") * 100, 1)
    runs = (
        run_summary(results, [by, "run"])
        .groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n_runs"),
            F.bround(F.min(percent), 0).cast("long").alias("_low"),
            F.bround(F.max(percent), 0).cast("long").alias("_high"),
            (F.min(percent) == F.max(percent)).alias("_equal"),
            F.min_by("total", "run").alias("total"),
        )
    )
    joined = runs.join(counts, by, "left").fillna(0, [*CATEGORIES, "compared"])
    low, high = F.col("_low").cast("string"), F.col("_high").cast("string")
    span = (
        F.when(F.col("n_runs") < 2, "N/A")
        .when(F.col("_equal"), F.concat(low, F.lit("%")))
        .otherwise(F.concat(low, F.lit("-"), high, F.lit("%")))
    )
    different = F.col("flip") + F.col("same_passed") + F.col("same_failed")
    share = F.coalesce(F.try_divide((F.col("total") - different) * 100.0, F.col("total").cast("double")), F.lit(0.0))
    return (
        joined.select(
            by,
            span.alias("accuracy_range"),
            F.col("flip").alias("outcome_flips"),
            share.alias("identical_pct"),
            F.col("total").alias("total_questions"),
            (F.col("total") - F.col("compared")).alias("not_compared"),
        )
        .withColumn("chart", bar(F.col("identical_pct")))
        .orderBy(F.desc("identical_pct"), by)
    )


def list_runs(results: DataFrame, prefix: str = "") -> DataFrame:
    """The runs to choose from, latest name first: a label of their dataset and time, and their keys."""
    dataset = F.coalesce(run_config(F.col("config"))["dataset"], F.lit(""))
    short = F.replace(dataset, F.lit(prefix), F.lit("")) if prefix else dataset
    found = results.select("config", "run").distinct()
    return found.withColumn("label", F.concat(short, F.lit(" / "), F.col("run"))).orderBy(F.desc("label"), "config")


def list_steps(results: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """The steps of each run in order, with the evals that have results there; -1 is a run without steps."""
    evals = F.array_join(F.array_sort(F.collect_set("eval")), ", ")
    steps = results.select(*by, "step", "eval").distinct().groupBy(*by, "step").agg(evals.alias("evals"))
    name = F.when(F.col("step") == -1, "(no step)").otherwise(F.concat(F.lit("Step "), F.col("step").cast("string")))
    return steps.withColumn("label", F.concat(name, F.lit(" — "), F.col("evals"))).orderBy(*by, "step")


def previous_step(results: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Each step of a run and the step before it, whichever evals they have.

    The window runs over distinct steps, a few per run.
    """
    steps = results.select(*by, "step").distinct()
    before = F.lag("step").over(Window.partitionBy(*by).orderBy("step"))
    return steps.withColumn("prev_step", before)


def step_diff(results: DataFrame, per_eval: bool = False) -> DataFrame:
    """Each result against the same problem at the previous step.

    ``diff`` is ``new`` (problem not in the previous step), ``new_pass``, ``new_fail`` or ``same``;
    NULL at a run's first step, and where the previous step has no results of this eval. Takes one
    row per (run, eval, step, problem). The step before may be one of any eval, unless
    ``per_eval``.
    """
    steps = results.select("run", "eval", "step").distinct()
    before = previous_step(steps, ["run", "eval"] if per_eval else ["run"])
    known = steps.join(before, ["run", "eval", "step"] if per_eval else ["run", "step"])
    previous = steps.select("run", "eval", F.col("step").alias("prev_step"), F.lit(True).alias("_has_prev"))
    # One row per step; once written, its size decides whether the results are shuffled for it.
    known = saved_once(known.join(previous, ["run", "eval", "prev_step"], "left"), "steps")
    # A problem has at most one row per step, so this window is as short as a run has steps.
    history = Window.partitionBy("run", "eval", "problem").orderBy("step")
    seen = results.withColumns(
        {"_seen_step": F.lag("step").over(history), "_seen_correct": F.lag("is_correct").over(history)}
    )
    joined = seen.join(known, ["run", "eval", "step"])
    was_there = F.coalesce(F.col("_seen_step") == F.col("prev_step"), F.lit(False))
    was = F.coalesce("_seen_correct", F.lit(False))
    now = F.coalesce("is_correct", F.lit(False))
    diff = (
        F.when(F.col("_has_prev").isNull(), F.lit(None))
        .when(~was_there, "new")
        .when(now & ~was, "new_pass")
        .when(~now & was, "new_fail")
        .otherwise("same")
    )
    return joined.withColumn("diff", diff).drop("_seen_step", "_seen_correct", "_has_prev")


def filter_results(diffed: DataFrame, mode: str = "all") -> DataFrame:
    """Results to look at: all, correct, incorrect, newly_solved or newly_failed."""
    correct = F.coalesce("is_correct", F.lit(False))
    modes = {
        "all": F.lit(True),
        "correct": correct,
        "incorrect": ~correct,
        "newly_solved": F.coalesce(F.col("diff") == "new_pass", F.lit(False)),
        "newly_failed": F.coalesce(F.col("diff") == "new_fail", F.lit(False)),
    }
    return diffed.filter(modes[mode])


def step_header(diffed: DataFrame, legacy_zero: bool = False) -> DataFrame:
    """Per (run, eval, step): totals, accuracy, and the change since the previous step.

    Changes are NULL where the previous step has no results of this eval; ``legacy_zero`` takes
    those as 0 correct out of 0.
    """
    per_step = diffed.groupBy("run", "eval", "step").agg(
        F.first("prev_step", ignorenulls=True).alias("prev_step"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce("is_correct", F.lit(False))).alias("correct"),
        F.count_if(F.col("diff") == "new_pass").alias("newly_solved"),
        F.count_if(F.col("diff") == "new_fail").alias("newly_failed"),
    )
    per_step = per_step.withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("total")))
    history = Window.partitionBy("run", "eval").orderBy("step")
    known = F.lag("step").over(history) == F.col("prev_step")

    def before(column: str) -> Column:
        value = F.when(known, F.lag(column).over(history))
        return F.when(F.col("prev_step").isNotNull(), F.coalesce(value, F.lit(0))) if legacy_zero else value

    return per_step.withColumns(
        {
            "delta_correct": F.col("correct") - before("correct"),
            "delta_accuracy": F.col("accuracy") - before("accuracy"),
        }
    )
