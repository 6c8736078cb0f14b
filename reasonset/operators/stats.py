"""Corpus statistics for every choice of source and domain, from one scan.

All figures come from one pre-aggregation to (source, domain, difficulty, rows). Counting is
combined before the shuffle, so that a source with a third of all rows costs no more than another,
and everything after it works on a table whose size is the number of distinct combinations.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved_once

ALL = "all"

MEASURES = ["total_rows", "unique_sources", "unique_domains", "avg_difficulty", "min_difficulty", "max_difficulty"]


def preaggregate(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "domain", "difficulty").agg(F.count(F.lit(1)).alias("n"))


def counted(df: DataFrame) -> DataFrame:
    """The pre-aggregation, written: choices, distributions and options all come from it, and the table is read once."""
    return saved_once(preaggregate(df), "counts")


def _measures() -> list[Column]:
    known = F.col("difficulty").isNotNull()
    return [
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"),
        F.count_distinct("source").alias("unique_sources"),
        F.count_distinct("domain").alias("unique_domains"),
        F.try_divide(F.sum(F.col("difficulty") * F.col("n")).cast("double"), F.sum(F.when(known, F.col("n")))).alias(
            "avg_difficulty"
        ),
        F.min("difficulty").alias("min_difficulty"),
        F.max("difficulty").alias("max_difficulty"),
    ]


def basic_stats(df: DataFrame) -> DataFrame:
    """One row: row count, distinct sources and domains, and the range and mean of difficulty."""
    return preaggregate(df).agg(*_measures())


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, NULL being one of them: difficulty in order, names by count."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if column == "difficulty":
        return counts.orderBy(F.col(column).asc_nulls_last())
    return counts.orderBy(F.desc("n"), F.col(column).asc_nulls_last())


def filter_options(df: DataFrame) -> DataFrame:
    """One row: the sorted distinct non-empty sources and domains, and the difficulty range."""
    return options_of(preaggregate(df))


def options_of(counts: DataFrame) -> DataFrame:
    """:func:`filter_options` of a pre-aggregated table."""
    def names(column: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col(column) != "", F.col(column))))

    return counts.agg(
        names("source").alias("sources"),
        names("domain").alias("domains"),
        F.min("difficulty").alias("difficulty_min"),
        F.max("difficulty").alias("difficulty_max"),
    )


def count_matching(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate).agg(F.count(F.lit(1)).alias("n"))


def all_pairs(options: DataFrame) -> DataFrame:
    """Every (source or all, domain or all) pair, by unrolling the two lists of one options row."""
    def choices(column: str) -> Column:
        return F.explode(F.array_union(F.array(F.lit(ALL)), F.col(column)))

    return options.select(choices("sources").alias("source"), "domains").select(
        "source", choices("domains").alias("domain")
    )


def _real(source: str = "_s", domain: str = "_d") -> Column:
    """Drops cube rows of a value literally called ``all``: that choice means no restriction."""
    def clash(level: str, name: str) -> Column:
        return (F.col(level) == 0) & F.coalesce(F.col(name) == ALL, F.lit(False))

    return ~clash(source, "source") & ~clash(domain, "domain")


def stats_cube(df: DataFrame, options: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """The basic statistics of every (source, domain) choice; choices without rows included.

    ``counts`` is :func:`counted` of the table where that is at hand.
    """
    base = counted(df) if counts is None else counts
    options = options_of(base) if options is None else options
    cube = (
        base.withColumns({"s": F.col("source"), "d": F.col("domain")})
        .cube("s", "d")
        .agg(F.grouping("s").alias("_s"), F.grouping("d").alias("_d"), *_measures())
        .withColumnsRenamed({"s": "source", "d": "domain"})
        .filter(_real())
        .select(
            F.when(F.col("_s") == 1, ALL).otherwise(F.col("source")).alias("source"),
            F.when(F.col("_d") == 1, ALL).otherwise(F.col("domain")).alias("domain"),
            *MEASURES,
        )
    )
    joined = all_pairs(options).join(cube, ["source", "domain"], "left")
    return joined.fillna(0, ["total_rows", "unique_sources", "unique_domains"])


def stats_cube_dist(df: DataFrame, options: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Long form of the distributions: (source, domain, dimension, key, n) for every choice.

    A missing difficulty has the key ``None``, a missing source or domain the key ``null``.
    """
    base = counted(df) if counts is None else counts
    options = options_of(base) if options is None else options
    # Each pre-aggregated row counts in four choices and three dimensions.
    source_level = F.explode(F.array(F.lit(1), F.lit(0))).alias("_s")
    domain_level = F.explode(F.array(F.lit(1), F.lit(0))).alias("_d")
    keys = F.explode(
        F.array(
            F.struct(
                F.lit("difficulty").alias("dimension"),
                F.coalesce(F.col("difficulty").cast("string"), F.lit("None")).alias("key"),
            ),
            F.struct(F.lit("source").alias("dimension"), F.coalesce("source", F.lit("null")).alias("key")),
            F.struct(F.lit("domain").alias("dimension"), F.coalesce("domain", F.lit("null")).alias("key")),
        )
    ).alias("_k")
    spread = base.select("*", source_level).select("*", domain_level).filter(_real()).select("*", keys)
    found = spread.groupBy(
        F.when(F.col("_s") == 1, ALL).otherwise(F.col("source")).alias("source"),
        F.when(F.col("_d") == 1, ALL).otherwise(F.col("domain")).alias("domain"),
        F.col("_k.dimension").alias("dimension"),
        F.col("_k.key").alias("key"),
    ).agg(F.sum("n").alias("n"))
    return found.join(all_pairs(options), ["source", "domain"], "left_semi")


def stats_cube_maps(df: DataFrame, options: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Full statistics records: the measures and the three distributions as maps.

    A map has one entry per distinct name or difficulty of its choice, not per row.
    """
    counts = counted(df) if counts is None else counts
    options = options_of(counts) if options is None else options
    long = stats_cube_dist(df, options, counts)

    def entries(dimension: str) -> Column:
        entry = F.when(F.col("dimension") == dimension, F.struct("key", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(f"{dimension}_distribution")

    maps = long.groupBy("source", "domain").agg(entries("difficulty"), entries("source"), entries("domain"))
    joined = stats_cube(df, options, counts).join(maps, ["source", "domain"], "left")
    empty = F.create_map().cast("map<string,bigint>")
    for dimension in ("difficulty", "source", "domain"):
        column = f"{dimension}_distribution"
        joined = joined.withColumn(column, F.coalesce(F.col(column), empty))
    return joined


def lookup_stats(stats: DataFrame, source: str = ALL, domain: str = ALL) -> DataFrame:
    """The record of one choice; no row when there is none."""
    return stats.filter((F.col("source") == source) & (F.col("domain") == domain))
