"""Row filters over the corpus and over problems."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_filter(
    difficulty_min: int | str | None = None,
    difficulty_max: int | None = None,
    source: str | None = None,
    domain: str | None = None,
) -> Column:
    """The corpus predicate; comparisons with literals, so that it reaches the Parquet scan.

    ``difficulty_min="null"`` asks for rows without difficulty; the maximum counts only next to a
    numeric minimum; an empty name or ``"all"`` does not restrict.
    """
    wanted = []
    if difficulty_min == "null":
        wanted.append(F.col("difficulty").isNull())
    elif difficulty_min is not None:
        wanted.append(F.col("difficulty") >= difficulty_min)
        if difficulty_max is not None:
            wanted.append(F.col("difficulty") <= difficulty_max)
    for column, value in (("source", source), ("domain", domain)):
        if value and value != "all":
            wanted.append(F.col(column) == value)
    return reduce(lambda a, b: a & b, wanted, F.lit(True)) if len(wanted) != 1 else wanted[0]


def token_budget(df: DataFrame, max_tokens: int, max_assistant_tokens: int | None = None) -> DataFrame:
    """Rows whose conversation, and whose answer when a second limit is set, fit the budget."""
    return df.filter(budget(max_tokens, max_assistant_tokens))


def budget(max_tokens: int, max_assistant_tokens: int | None = None) -> Column:
    fits = F.col("_total_tokens") <= max_tokens
    if max_assistant_tokens is not None:
        fits = fits & (F.col("_assistant_tokens") <= max_assistant_tokens)
    return fits


def date_window(df: DataFrame, column: str, first: str = "2024-08-01", end: str = "2025-02-01") -> DataFrame:
    """Rows with ``first <= column < end``; a plain range, so that row groups can be skipped."""
    dtype = df.schema[column].dataType
    return df.filter((F.col(column) >= F.lit(first).cast(dtype)) & (F.col(column) < F.lit(end).cast(dtype)))


def unknown_values(requested: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Requested values that the catalogue does not have; ``"all"`` is always known."""
    return requested.filter(F.col(column) != "all").join(known.select(column), column, "left_anti")


def has_test_type(tests: Column, kind: str) -> Column:
    """Whether any test case in a JSON list has the given ``testtype``."""
    cases = F.from_json(tests, "array<struct<testtype:string>>")
    return F.coalesce(F.exists(cases, lambda t: F.coalesce(t["testtype"] == kind, F.lit(False))), F.lit(False))


def missing_difficulty(df: DataFrame, column: str = "difficulty") -> Column:
    if column not in df.columns:
        raise ValueError(f"an order by difficulty needs a column {column!r}, but there is none")
    missing = F.col(column).isNull()
    if df.schema[column].dataType.typeName() in ("double", "float"):
        missing = missing | F.isnan(column)
    return missing


def check_difficulty(df: DataFrame, key: str = "id", column: str = "difficulty", show: int = 5) -> DataFrame:
    """The first offending rows of a difficulty check, each with the number of all offenders.

    Empty when every row has a difficulty.
    """
    offenders = df.filter(missing_difficulty(df, column)).select(key)
    total = offenders.agg(F.count(F.lit(1)).alias("n")).scalar()
    return offenders.orderBy(key).limit(show).withColumn("n_missing", total)


def pick_train_split(splits: DataFrame, by: Sequence[str], split: str = "split", order: str = "split_no") -> DataFrame:
    """Per group the split to use: ``train``, else ``validation``, else the first one.

    Whatever was picked is called ``train`` from then on; ``picked_split`` keeps its old name.
    """
    rank = F.struct(
        F.when(F.col(split) == "train", 0).when(F.col(split) == "validation", 1).otherwise(2).alias("rank"),
        F.col(order).alias("order"),
    )
    return splits.groupBy(*by).agg(F.min_by(split, rank).alias("picked_split")).withColumn("split", F.lit("train"))
