"""Scans of evaluation results, problem sets, and comparison summaries."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, names

RESULT = (
    "index bigint, problem_id string, problem string, target_answer string, correct_answer string, prompt string, "
    "samples array<struct<sample_idx:bigint,content:string,model_answer:string,extracted_answer:string,"
    "is_correct:boolean,error:string>>, pass_at_k bigint, is_correct boolean, difficulty string"
)


def read_results(spark: SparkSession, root: str, pattern: str = "*.json*") -> DataFrame:
    """All result files below ``root`` with the keys of their paths; blank lines are skipped, a broken line
    fails the read.

    The schema is given, so that no pass over the files is needed to infer it.
    """
    files = (
        spark.read.schema(RESULT).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)
    )
    return with_run_keys(files.select("*", F.col("_metadata.file_path").alias("path"))).drop("path")


def with_run_keys(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds (config, run, eval, step) from the path; files in an unreadable step folder go."""
    keys = names.run_keys(F.col(path))
    return df.withColumn("_keys", keys).select("*", "_keys.*").drop("_keys").filter(F.col("step").isNotNull())


def explode_samples(results: DataFrame) -> DataFrame:
    """One row per sample, in the form the scoring and comparison operators take.

    A result without samples becomes one row with the result's own verdict and no text. Prompt, target, difficulty
    and pass@k of the result come along.
    """
    target = F.coalesce("correct_answer", "target_answer").alias("target")
    exploded = results.select(
        "config", "run", "eval", "step", F.col("index").alias("problem"), "problem_id", F.coalesce("prompt", "problem").alias("prompt"),
        target, "difficulty", "pass_at_k", F.col("is_correct").alias("verdict"), F.posexplode_outer("samples"),
    )
    return exploded.select(
        "config",
        "run",
        "eval",
        "step",
        "problem",
        F.coalesce("col.sample_idx", F.col("pos").cast("long"), F.lit(0)).alias("sample_idx"),
        F.coalesce("col.content", F.lit("")).alias("response"),
        F.coalesce("col.extracted_answer", "col.model_answer", F.lit("")).alias("answer"),
        F.coalesce("col.is_correct", "verdict", F.lit(False)).alias("is_correct"),
        F.coalesce("col.error", F.lit("")).alias("error"),
        "problem_id",
        "prompt",
        "target",
        "difficulty",
        "pass_at_k",
    )


def read_problems(spark: SparkSession, paths: str | Sequence[str], schema: str, fields: dict[str, str]) -> DataFrame:
    """Several problem files as one table; ``fields`` maps stored names to names of ours."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(paths if isinstance(paths, str) else list(paths))
    return to_problem(df, fields)


def to_problem(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A problem table: chosen columns under our names, identifiers and answers as texts."""
    text = {"problem", "answer", "prompt"}
    return df.select(
        *[F.col(stored).cast("string").alias(ours) if ours in text else F.col(stored).alias(ours)
          for stored, ours in fields.items()]
    )


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Comparison summaries, one file per row, with the model named in the path."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("content"), F.col("_metadata.file_path").alias("path")
    )
    return parse_summaries(files.withColumn("model", names.model_name(F.col("path"))))


def parse_summaries(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds the figures of a comparison summary: accuracies, flips, and identical responses.

    A summary without run lines counts as 100 questions; missing counts are 0.
    """
    text = F.col(content)

    def group(pattern: str, number: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(number))

    def count(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("long"), F.lit(0).cast("long"))

    percents = F.transform(group(fixed.SUMMARY_PASSED, 3), lambda p: p.cast("double"))
    total = F.coalesce(F.try_element_at(group(fixed.SUMMARY_PASSED, 2), F.lit(1)).cast("long"), F.lit(100).cast("long"))
    figures = df.withColumns(
        {
            "accuracies": percents,
            "total": total,
            "outcome_flips": count(fixed.SUMMARY_FLIPS),
            "same_diff": count(fixed.SUMMARY_SAME_DIFF),
        }
    )
    identical = F.col("total") - F.col("outcome_flips") - F.col("same_diff")
    return figures.withColumn("identical", identical).withColumn(
        "identical_pct",
        F.coalesce(F.try_divide(F.col("identical").cast("double"), F.col("total").cast("double")) * 100, F.lit(0.0)),
    )


def summary_table(parsed: DataFrame, by: str = "model") -> DataFrame:
    """The determinism leaderboard from parsed summaries, best first."""
    low, high = F.array_min("accuracies"), F.array_max("accuracies")

    def whole(value: Column) -> Column:
        return F.bround(value, 0).cast("long").cast("string")

    span = (
        F.when(F.size("accuracies") < 2, "N/A")
        .when(low == high, F.concat(whole(low), F.lit("%")))
        .otherwise(F.concat(whole(low), F.lit("-"), whole(high), F.lit("%")))
    )
    return parsed.select(
        by,
        names.model_type(F.col(by)).alias("model_type"),
        span.alias("accuracy_range"),
        "outcome_flips",
        "identical_pct",
        F.col("total").alias("total_questions"),
    ).orderBy(F.desc("identical_pct"), by)
