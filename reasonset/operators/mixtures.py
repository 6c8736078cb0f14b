"""Mixtures of sources: subsets that take given shares from several sources at once."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved_once
from .position import range_bucket, with_position


def _exact(column: Column) -> Column:
    return column.cast("decimal(19, 0)")


def mixture_quotas(mixtures: DataFrame, available: DataFrame) -> DataFrame:
    """How many rows each mixture takes from each source: ``mixture``, ``source``, ``quota``.

    ``mixtures`` has ``mixture``, ``source``, ``weight`` (a whole number) and ``total``; ``available`` has ``source`` and ``rows``. A mixture's
    total is shared by weight; a source that has fewer rows than its share gives all of them, and what it
    lacks is shared among the others, by weight again. Fractions go to the largest remainders, ties to the
    smaller source name. A mixture gets its total exactly, or all its sources have. Sources without rows or positive
    weight are left out; a source that is named twice has the sum of its weights.
    """
    asked = mixtures.where("weight > 0 AND source IS NOT NULL").groupBy("mixture", "source").agg(F.sum("weight").alias("weight"), F.max("total").alias("total"))
    known = asked.join(available.where("rows > 0").select("source", "rows"), "source")
    # Sources in the order in which they run dry: as soon as one does not, neither do those behind it.
    by_scarcity = Window.partitionBy("mixture").orderBy(F.col("rows") / F.col("weight"), "source")
    left = F.col("total") - F.coalesce(F.sum("rows").over(by_scarcity.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(by_scarcity.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    dry = known.withColumn("_left", left).withColumn("_weights", weights)
    dry = dry.withColumn("_dry", _exact(F.col("_left")) * _exact(F.col("weight")) >= _exact(F.col("rows")) * _exact(F.col("_weights")))
    whole = Window.partitionBy("mixture")
    shared = dry.withColumns(
        {
            "_rest": F.col("total") - F.sum(F.when(F.col("_dry"), F.col("rows")).otherwise(0)).over(whole),
            "_among": F.sum(F.when(~F.col("_dry"), F.col("weight")).otherwise(0)).over(whole),
        }
    )
    product = "cast(_rest AS decimal(19, 0)) * cast(weight AS decimal(19, 0))"
    split = shared.withColumn("_floor", F.when(F.col("_dry"), F.col("rows")).otherwise(F.expr(f"({product}) div nullif(_among, 0)")))
    split = split.withColumn("_over", F.when(~F.col("_dry"), F.expr(f"({product}) % nullif(_among, 0)")))
    split = split.withColumn("_missing", F.col("total") - F.sum("_floor").over(whole))
    place = F.row_number().over(whole.orderBy(F.desc_nulls_last("_over"), "source"))
    more = F.when(~F.col("_dry") & (place <= F.col("_missing")), 1).otherwise(0)
    return split.select("mixture", "source", (F.col("_floor") + more).cast("long").alias("quota")).where("quota > 0")


def source_mixtures(df: DataFrame, mixtures: DataFrame, key: str = "id") -> DataFrame:
    """The rows of every mixture, with ``mixture``: from each source its quota in key order; a row may be in several mixtures.

    ``key`` is unique, numeric and not null. Positions are worked out for the keys alone; the rows are read once and filtered by one cut-off key per
    mixture and source, a table that is written first so that its true size decides how it is joined.
    """
    keys = saved_once(df.select("source", key), "keys")
    quotas = mixture_quotas(mixtures, keys.groupBy("source").agg(F.count(F.lit(1)).alias("rows")))
    placed = with_position(keys, [F.col(key)], [range_bucket(keys, key)], by=["source"], name="_place")
    cuts = placed.join(saved_once(quotas, "quotas"), "source").where("_place = quota - 1")
    cuts = saved_once(cuts.select("mixture", F.col("source").alias("_source"), F.col(key).alias("_cut")), "cuts")
    return df.join(cuts, F.col("source") == F.col("_source")).where(F.col(key) <= F.col("_cut")).drop("_source", "_cut")
