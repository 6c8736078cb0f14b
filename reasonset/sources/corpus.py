"""Corpus scans."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages


def read_corpus(spark: SparkSession, path: str, order_key: bool = False) -> DataFrame:
    """A corpus of Parquet shards; ``path`` may be a glob.

    ``order_key`` adds ``file_name`` and ``row_index``, the stored order for corpora whose
    examples have no number of their own.
    """
    df = spark.read.parquet(path)
    if not order_key:
        return df
    return df.select("*", F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))


def decode_messages(df: DataFrame, column: str = "conversations", to: str = "messages") -> DataFrame:
    """Adds ordered (role, text) messages, from a JSON string or an array in either key style."""
    stored = df.schema[column].dataType
    if stored.typeName() == "string":
        return df.withColumn(to, messages.from_json_text(F.col(column)))
    fields = stored.elementType.fieldNames()
    styles = ["from", "value", "role", "content"]
    padded = F.transform(
        F.col(column),
        lambda t: F.struct(*[(t[s] if s in fields else F.lit(None).cast("string")).alias(s) for s in styles]),
    )
    return df.withColumn(to, messages.from_raw(padded))
