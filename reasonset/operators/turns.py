"""Conversations kept as one row per turn: the same figures as over nested messages.

Texts are measured where they are read; what is shuffled per turn is a few numbers, combined before
the shuffle. A conversation that holds a large part of all turns is therefore no heavier than
another, and only the texts that are asked for move.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, messages
from ..functions.text import cut


def nest_turns(df: DataFrame, key: str = "id", turn: str = "turn", keep: Sequence[str] = ()) -> DataFrame:
    """One row of ordered messages per conversation, with the columns of ``keep``, equal in all its turns.

    A conversation has to fit in a row: that is what a nested corpus stores. Figures of conversations
    of any length come from the other functions here, which never nest them.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "role", "text")))
    return df.groupBy(key, *keep).agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("messages")
    )


def _first(value: Column, roles: list[str], turn: str) -> Column:
    return F.min_by(value, F.when(F.col("role").isin(roles), F.col(turn)))


def with_tokens(df: DataFrame, key: str = "id", turn: str = "turn") -> DataFrame:
    """Per conversation the subset token estimates: of all turns and of the first assistant turn."""
    tokens = messages.text_tokens(F.col("text"))
    return df.groupBy(key).agg(
        F.sum(tokens).alias("_total_tokens"),
        F.coalesce(_first(tokens, fixed.ASSISTANT_ROLES, turn), F.lit(0)).cast("long").alias("_assistant_tokens"),
    )


def with_browse_tokens(df: DataFrame, key: str = "id") -> DataFrame:
    """Per conversation the browsing token estimate, rounded down once."""
    chars = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return df.groupBy(key).agg(F.floor(chars / 4).cast("long").alias("tokens"))


def first_turns(df: DataFrame, key: str = "id", turn: str = "turn") -> DataFrame:
    """Per conversation the first user text and the first assistant text, empty when missing."""
    def first(roles: list[str]) -> Column:
        return F.coalesce(_first(F.col("text"), roles, turn), F.lit(""))

    return df.groupBy(key).agg(
        first(fixed.USER_ROLES).alias("user_text"), first(fixed.ASSISTANT_ROLES).alias("assistant_text")
    )


def previews(df: DataFrame, key: str = "id", turn: str = "turn", max_len: int = 500) -> DataFrame:
    """Per conversation the start of its first user turn; texts are cut before they are shuffled."""
    first = _first(cut(F.coalesce("text", F.lit("")), max_len), fixed.USER_ROLES, turn)
    return df.groupBy(key).agg(F.coalesce(first, F.lit(fixed.NO_USER_MESSAGE)).alias("preview"))


def browse_table(examples: DataFrame, df: DataFrame, key: str = "id", turn: str = "turn") -> DataFrame:
    """What a browsing page shows of each example; an example without turns has no conversation."""
    chars = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    start = cut(F.coalesce("text", F.lit("")), 500)
    shown = df.groupBy(key).agg(
        F.floor(chars / 4).cast("long").alias("tokens"),
        F.coalesce(_first(start, fixed.USER_ROLES, turn), F.lit(fixed.NO_USER_MESSAGE)).alias("preview"),
    )
    return examples.join(shown, key, "left").select(
        key,
        "difficulty",
        F.coalesce("source", F.lit(fixed.NOT_AVAILABLE)).alias("source"),
        F.coalesce("domain", F.lit(fixed.NOT_AVAILABLE)).alias("domain"),
        F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
        F.coalesce("preview", F.lit(fixed.NO_CONVERSATION)).alias("preview"),
    )


def mark_target(df: DataFrame, key: str = "id", turn: str = "turn") -> DataFrame:
    """Every turn with its training role, and a flag on each conversation's last assistant turn.

    The last turn is found from numbers alone and joined back, which, unlike a window over each
    conversation, lets a very long conversation be spread over several tasks.
    """
    role = F.when(F.col("role").isin(fixed.USER_ROLES), "user").otherwise("assistant")
    mapped = df.withColumn("role", role)
    last = mapped.groupBy(F.col(key).alias("_key")).agg(
        F.max(F.when(F.col("role") == "assistant", F.col(turn))).alias("_last")
    )
    joined = mapped.join(last, F.col(key) == F.col("_key"))
    return joined.withColumn("is_target", F.coalesce(F.col(turn) == F.col("_last"), F.lit(False))).drop("_key", "_last")
