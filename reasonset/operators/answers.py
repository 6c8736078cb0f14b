"""Answers side by side: those of two models to the same prompt, and all those that one input has got."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diff
from ..session import saved_once
from .position import with_position


def answer_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """The edits between the answers of two models, such as a base and a tuned one, for prompts that both have answered.

    Adds ``script`` and how many words it keeps, deletes and inserts. ``keys`` name an answer in each table; a null key meets a null key.
    """
    both = left.select(*keys, F.col(text).alias("left_text"))
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(text).alias("right_text"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = both.join(other, same).drop(*[f"_{k}" for k in keys])
    scripted = joined.withColumn("script", diff.text_script(F.col("left_text"), F.col("right_text")))
    ops = {"kept": diff.KEEP, "deleted": diff.DELETE, "inserted": diff.INSERT}
    return scripted.withColumns({f"words_{name}": diff.words_of(F.col("script"), op) for name, op in ops.items()})


def _digest(column: str):
    """A null text is an input of its own."""
    return F.coalesce(F.md5(F.col(column)), F.lit(""))


def same_input_groups(df: DataFrame, key: str = "id", input_col: str = "input", response_col: str = "response") -> DataFrame:
    """Per row: the group of its input, and which of the group's different responses it has.

    ``key``, ``input_id`` (the smallest key with that input), ``samples`` (rows of the group), ``links`` (its other rows),
    ``responses`` (different ones), ``response_no`` (from 0, in the order of digests), ``copies`` (rows with that response too)
    and ``is_first`` (the smallest key of the response). Only digests are shuffled. Equal rows are one from the first aggregate on, and the
    responses of an input are numbered inside ranges of their digests, so that a frequent input is never whole in one task.
    """
    keyed = df.select(key, _digest(input_col).alias("_input"), _digest(response_col).alias("_response"))
    copies = saved_once(keyed.groupBy("_input", "_response").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("copies")), "responses")
    groups = copies.groupBy("_input").agg(F.sum("copies").alias("samples"), F.count(F.lit(1)).alias("responses"), F.min("_first").alias("input_id"))
    numbered = with_position(copies, [F.col("_response")], [F.substring("_response", 1, 2)], by=["_input"], name="response_no")
    rows = keyed.join(numbered, ["_input", "_response"]).join(groups, "_input")
    return rows.select(
        key, "input_id", "samples", (F.col("samples") - 1).alias("links"), "responses", "response_no", "copies", F.col(key).eqNullSafe(F.col("_first")).alias("is_first")
    )


def sampled_inputs(df: DataFrame, least: int = 2, key: str = "id", input_col: str = "input", response_col: str = "response") -> DataFrame:
    """The rows of inputs with at least ``least`` different responses, one row per response; ``key`` has to be unique."""
    groups = same_input_groups(df, key, input_col, response_col).where(f"responses >= {least} AND is_first")
    return df.join(groups.select(key, "input_id", "responses", "response_no"), key)
