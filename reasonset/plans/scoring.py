"""Scoring of an evaluation's stored samples, from texts to the metric records of each step."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from ..operators import scoring

#: How a problem is graded: by the boxed choice, by the final answer, or by a verdict that the samples bring along.
LETTER, ANSWER, VERDICT = "letter", "answer", "verdict"


def graded(samples: DataFrame, problems: DataFrame) -> DataFrame:
    """Adds to each sample whether it is correct, as its problem's ``kind`` says.

    Takes samples (eval, problem, content, and ``is_correct`` where verdicts were worked out elsewhere) and problems (eval,
    problem, target, kind), unique by eval and problem. A sample of an unknown problem, without a text, or without a target to
    compare with is not correct; an empty answer agrees with nothing.
    """
    text = F.coalesce("content", F.lit(""))
    verdict = F.coalesce("is_correct", F.lit(False)) if "is_correct" in samples.columns else F.lit(False)
    # Read in the scan, so that answers meet the problems and not whole texts.
    read = samples.withColumns({"_letter": answers.extract_letter(text), "_answer": answers.extract_answer(text)})
    letter, answer = F.col("_letter"), F.col("_answer")

    def given(found: Column, same: Column) -> Column:
        return (found != "") & F.coalesce(same, F.lit(False))

    correct = (
        F.when(F.col("kind") == LETTER, given(letter, letter == F.col("target")))
        .when(F.col("kind") == ANSWER, given(answer, answers.same_answer(answer, F.col("target"))))
        .when(F.col("kind") == VERDICT, verdict)
        .otherwise(F.lit(False))
    )
    known = problems.select("eval", "problem", "target", "kind", F.lit(True).alias("_known"))
    return read.join(known, ["eval", "problem"], "left").withColumn("is_correct", correct).drop("target", "kind", "_letter", "_answer")


def score_samples(samples: DataFrame, problems: DataFrame, k: int = 1, by: Sequence[str] = ("run", "step")) -> DataFrame:
    """Metric records (``by``, ``metric``, ``value``): per eval the share of its problems that any sample solved, as ``<eval>_pass@<k>``.

    Problems without samples stay in the denominator; an eval without problems gives 0. Answers are shuffled to their problems,
    then one flag per sample, combined per problem and per eval before it is.
    """
    by = [*by, "eval"]
    one = graded(samples, problems).select(*by, "problem", "is_correct", "_known")
    per_problem = scoring.pass_at_k(one.filter("_known"), [*by, "problem"])
    solved = per_problem.groupBy(*by).agg(F.count_if("is_correct").alias("n_correct"))
    sizes = problems.groupBy("eval").agg(F.count(F.lit(1)).alias("n_problems"))
    seen = samples.select(*by).distinct()
    found = seen.join(solved, by, "left").join(sizes, "eval", "left")
    value = F.coalesce(F.try_divide(F.col("n_correct").cast("double"), F.col("n_problems")), F.lit(0.0))
    return found.select(*by[:-1], F.concat("eval", F.lit(f"_pass@{k}")).alias("metric"), value.alias("value"))
