"""Scoring of stored model answers: grading, pass@k and accuracy."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers, arrays


def grade(df: DataFrame, content: str = "content", target: str = "target") -> DataFrame:
    """Adds the extracted answer and whether it agrees with the target."""
    answer = answers.extract_answer(F.col(content))
    return df.withColumn("model_answer", answer).withColumn(
        "is_correct", answers.same_answer(F.col("model_answer"), F.col(target))
    )


def attach_samples(
    problems: DataFrame, samples: DataFrame, by: Sequence[str] = ("problem",), missing: str = "fail", k: int = 1
) -> DataFrame:
    """Every problem's samples; a problem without any gets ``k`` rows that are not correct.

    Errors that samples carry stay. ``missing="skip"`` leaves problems without samples out. Answered problems are an inner join, whose skewed
    partitions Spark can split when one problem has very many samples; the others are found
    against the distinct problems.
    """
    by = list(by)
    answered = problems.join(samples, by)
    answered = answered.withColumn("is_correct", F.coalesce("is_correct", F.lit(False)))
    if missing == "skip":
        return answered
    silent = problems.join(samples.select(*by).distinct(), by, "left_anti")
    silent = silent.withColumn("is_correct", F.lit(False)).withColumn("error", F.lit("No response"))
    if k != 1:
        silent = silent.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(k)))).drop("_k")
    error = F.coalesce("error", F.lit("")) if "error" in answered.columns else F.lit("")
    return answered.withColumn("error", error).unionByName(silent, allowMissingColumns=True)


def pass_at_k(samples: DataFrame, by: Sequence[str] = ("problem",)) -> DataFrame:
    """Per problem: the number of samples and whether any of them is correct."""
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"),
        F.bool_or(F.coalesce("is_correct", F.lit(False))).alias("is_correct"),
    )


def accuracy(problems: DataFrame, samples: DataFrame, by: Sequence[str], problem: str = "problem") -> DataFrame:
    """Per run, eval or step (``by``): solved problems over all problems of the set.

    A problem without samples stays in the denominator; an empty problem set, and a run without a
    sample of the set, give 0. Samples are reduced to one row per problem before they meet the problem set.
    """
    problem_set = problems.select(problem).distinct()
    size = problem_set.agg(F.count(F.lit(1)).alias("n")).scalar()
    inside = problem_set.withColumn("_in", F.lit(True))
    known = pass_at_k(samples, [*by, problem]).join(inside, problem, "left")
    solved = known.groupBy(*by).agg(
        F.count_if(F.col("is_correct") & F.col("_in")).alias("n_correct"), F.count("_in").alias("n_answered")
    )
    return solved.withColumn("n_problems", size).withColumn(
        "accuracy", F.coalesce(F.try_divide(F.col("n_correct").cast("double"), F.col("n_problems")), F.lit(0.0))
    )


def sample_verdict(samples: DataFrame, tests: DataFrame, results: DataFrame) -> DataFrame:
    """Whether each sample passed all tests of its problem; a test never reached counts as failed.

    Takes samples (problem, sample), tests (problem, test), results (problem, sample, test,
    passed). Passed tests are counted per sample instead of pairing every sample with every test.
    """
    per_test = results.groupBy("problem", "sample", "test").agg(F.bool_and("passed").alias("passed"))
    wanted = per_test.join(tests.distinct(), ["problem", "test"], "left_semi")
    passed = wanted.groupBy("problem", "sample").agg(F.count_if("passed").alias("n_passed"))
    needed = tests.distinct().groupBy("problem").agg(F.count(F.lit(1)).alias("n_tests"))
    joined = samples.join(passed, ["problem", "sample"], "left").join(needed, "problem", "left")
    return joined.select(
        "problem",
        "sample",
        F.coalesce("n_passed", F.lit(0)).cast("long").alias("n_passed"),
        F.coalesce("n_tests", F.lit(0)).cast("long").alias("n_tests"),
    ).withColumn("is_correct", F.col("n_passed") == F.col("n_tests"))


def mean_nll(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean negative log-likelihood, the sum of -logprob * weight over the sum of weights."""
    sums = df.select(
        *by, arrays.dot(F.col("logprobs"), F.col("weights")).alias("s"), arrays.total(F.col("weights")).alias("w")
    )
    return sums.groupBy(*by).agg(F.try_divide(-F.sum("s"), F.sum("w")).alias("nll"))


def batch_counters(df: DataFrame) -> DataFrame:
    """Per step: sequences, tokens, and tokens that count in the loss."""
    return df.groupBy("step").agg(
        F.count(F.lit(1)).alias("num_sequences"),
        F.sum(F.size("tokens")).cast("long").alias("num_tokens"),
        F.sum(arrays.total(F.col("weights"))).alias("num_loss_tokens"),
    )
