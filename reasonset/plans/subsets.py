"""Subset generation from a corpus to a saved, described subset."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, messages
from ..functions.names import subset_name
from ..operators import corpus
from ..operators.predicates import unknown_values
from ..sinks import writers
from ..sources.saved import read_subset


def validate(options: DataFrame, source: str = "all", domain: str = "all") -> None:
    """Fails when a wanted source or domain is not in the catalogue."""
    for column, value in (("source", source), ("domain", domain)):
        wanted = options.sparkSession.createDataFrame([(value,)], f"{column} string")
        known = options.select(F.explode(f"{column}s").alias(column))
        if not unknown_values(wanted, known, column).isEmpty():
            raise ValueError(f"unknown {column}: {value}")


def generate_subset(
    df: DataFrame,
    root: str,
    max_tokens: int = 8192,
    limit: int = 100,
    max_assistant_tokens: int | None = None,
    source: str = "all",
    domain: str = "all",
    base_dataset: str = "",
    author: str = "",
    prefix: str = "corpus",
    created_at: str | None = None,
    key: str | Sequence[str] = "id",
) -> str | None:
    """Cuts a subset of a nested corpus and saves it; returns its name, or nothing when it is empty.

    ``key`` gives the stored order: a column, or several, such as the file name and row number of ``read_corpus(order_key=True)``.

    The chosen rows are written first, and statistics and samples come from the written table, so
    that the corpus is read once.
    """
    spark = df.sparkSession
    filters = {
        "source": source, "domain": domain, "max_tokens": max_tokens,
        "max_assistant_tokens": max_assistant_tokens, "limit": limit,
    }
    kinds = {"source": "string", "domain": "string"}
    values = [F.lit(v).cast(kinds.get(k, "long")) for k, v in filters.items()]
    name = spark.range(1).select(subset_name(*values, prefix=prefix)).first()[0]
    subset = corpus.make_subset(df, max_tokens, limit, max_assistant_tokens, source, domain, key=key)
    writers.write_rows(subset, root, name)
    saved = read_subset(spark, root, name)
    if saved is None or saved.isEmpty():
        return None
    stats = corpus.subset_stats(saved)
    writers.write_metadata(writers.subset_metadata(stats, name, base_dataset, filters, author, created_at), root, name)
    texts = saved.select(
        *([key] if isinstance(key, str) else key), "source", "domain", "difficulty",
        messages.first_text(F.col("messages"), fixed.USER_ROLES).alias("user_text"),
        messages.first_text(F.col("messages"), fixed.ASSISTANT_ROLES).alias("assistant_text"),
    )
    writers.write_documents(corpus.sample_documents(texts, key=key), f"{root}/samples/subset={name}")
    return name
