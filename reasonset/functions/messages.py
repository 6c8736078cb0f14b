"""Expressions over a conversation: an ordered array of (role, text) structs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import cut

MESSAGES = "array<struct<role:string,text:string>>"
RAW_TURN = "array<struct<`from`:string,value:string,role:string,content:string>>"


def from_raw(turns: Column) -> Column:
    """Turns that carry ``from``/``value`` or ``role``/``content`` keys, as messages."""
    return F.transform(
        turns,
        lambda t: F.struct(
            F.coalesce(t["from"], t["role"], F.lit("")).alias("role"),
            F.coalesce(t["value"], t["content"], F.lit("")).alias("text"),
        ),
    )


def from_json_text(conversation: Column) -> Column:
    """A conversation stored as a JSON string, as messages; both key styles may be mixed."""
    return from_raw(F.from_json(conversation, RAW_TURN))


def first_text(messages: Column, roles: list[str]) -> Column:
    """The text of the first turn spoken by one of ``roles``; empty when there is none."""
    spoken = F.filter(messages, lambda m: m["role"].isin(roles))
    return F.coalesce(F.try_element_at(spoken, F.lit(1))["text"], F.lit(""))


def text_tokens(text: Column) -> Column:
    """Estimated tokens of one text: a quarter of its characters, rounded down."""
    return F.coalesce(F.floor(F.length(text) / 4), F.lit(0)).cast("long")


def total_tokens(messages: Column) -> Column:
    """Token estimate used for subsets: every turn is rounded down on its own."""
    total = F.aggregate(messages, F.lit(0).cast("long"), lambda acc, m: acc + text_tokens(m["text"]))
    return F.coalesce(total, F.lit(0).cast("long"))


def browse_tokens(messages: Column) -> Column:
    """Token estimate shown when browsing: rounded down once, over all turns together."""
    chars = F.aggregate(
        messages, F.lit(0).cast("long"), lambda acc, m: acc + F.coalesce(F.length(m["text"]), F.lit(0)).cast("long")
    )
    return F.coalesce(F.floor(chars / 4).cast("long"), F.lit(0).cast("long"))


def preview(messages: Column, max_len: int = 500) -> Column:
    """The start of the first user turn."""
    asked = F.exists(messages, lambda m: m["role"].isin(fixed.USER_ROLES))
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), fixed.NO_CONVERSATION)
        .when(asked, cut(first_text(messages, fixed.USER_ROLES), max_len))
        .otherwise(fixed.NO_USER_MESSAGE)
    )


def mark_target(messages: Column) -> Column:
    """Messages for training: two roles only, and a flag on the last assistant turn.

    Whoever is not ``human`` or ``user`` counts as the assistant.
    """
    mapped = F.transform(
        messages,
        lambda m: F.struct(
            F.when(m["role"].isin(fixed.USER_ROLES), "user").otherwise("assistant").alias("role"),
            m["text"].alias("text"),
        ),
    )
    last = F.array_max(F.transform(mapped, lambda m, i: F.when(m["role"] == "assistant", i)))
    return F.transform(
        mapped,
        lambda m, i: F.struct(
            m["role"].alias("role"), m["text"].alias("text"), F.coalesce(i == last, F.lit(False)).alias("is_target")
        ),
    )
