"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(batches: Iterable[pa.RecordBatch], sized: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about ``most_bytes`` of the column ``sized``, or a single row.

    Rows keep their order and none is dropped; it only bounds what a Python worker holds at once.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(sized))
        if column.nbytes <= most_bytes or batch.num_rows <= 1:
            yield batch
            continue
        start, held = 0, 0
        for i in range(batch.num_rows):
            here = len(column[i].as_buffer()) if column[i].is_valid else 0
            if i > start and held + here > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += here
        yield batch.slice(start)
