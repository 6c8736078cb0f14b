"""Rewards of sampled answers, and what they are worth within their question."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_advantage(df: DataFrame, question: str = "question") -> DataFrame:
    """Each reward less its question's mean; questions whose rewards are all equal are dropped.

    The mean comes from an aggregate that is joined back. A window over each question would put
    all samples of a frequent question into one task; the aggregate is combined before the
    shuffle, and a skewed join partition can be split. Questions without signal leave before the
    join.
    """
    means = (
        df.groupBy(F.col(question).alias("_question"))
        .agg(F.avg("reward").alias("_mean"), F.min("reward").alias("_low"), F.max("reward").alias("_high"))
        .filter(F.col("_low") != F.col("_high"))
        .select("_question", "_mean")
    )
    joined = df.join(means, F.col(question) == F.col("_question"))
    return joined.withColumn("advantage", F.col("reward") - F.col("_mean")).drop("_question", "_mean")


def reward_stats(df: DataFrame) -> DataFrame:
    """Mean and sample standard deviation; the latter is NULL for a single reward."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg("reward").alias("mean_reward"), F.stddev_samp("reward").alias("std_reward")
    )


def batch_reward(df: DataFrame, question: str = "question") -> DataFrame:
    """Mean over all questions of their mean reward."""
    means = df.groupBy(question).agg(F.avg("reward").alias("mean"))
    return means.agg(F.count(F.lit(1)).alias("n_questions"), F.avg("mean").alias("batch_reward"))
