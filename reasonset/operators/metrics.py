"""Step metrics in long form (run, step, metric, value)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_metrics(base: DataFrame, late: DataFrame, order: str = "seq") -> DataFrame:
    """Late values put onto their step: they replace what was logged, and the last one wins.

    A late NULL replaces nothing.

    Both sides are stacked and the winner is an aggregate, which is combined before the one
    shuffle; a full outer join would need two.
    """
    stacked = base.withColumn("_late", F.lit(0)).unionByName(late.filter(F.col("value").isNotNull()).withColumn("_late", F.lit(1)))
    return stacked.groupBy("run", "step", "metric").agg(F.max_by("value", F.struct("_late", order)).alias("value"))


def mean_metric(df: DataFrame, pattern: str = "accuracy") -> DataFrame:
    """Per (run, step): the mean of the metrics whose name contains ``pattern``, in any case."""
    named = df.filter(F.contains(F.lower("metric"), F.lit(pattern.lower())))
    return named.groupBy("run", "step").agg(F.avg("value").alias("avg_value"))
