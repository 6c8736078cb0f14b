"""Step metrics as they arrive, in any order of steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def latest_metrics(stream: DataFrame, order: str = "seq") -> DataFrame:
    """The last value written for each (run, step, metric), late ones included.

    No watermark: a deferred evaluation may log onto a step long past. The state is one value per
    metric and step.
    """
    return stream.groupBy("run", "step", "metric").agg(F.max_by("value", order).alias("value"))


def log_metrics(stream: DataFrame, root: str, checkpoint: str, order: str = "seq") -> DataStreamWriter:
    """A writer that appends each batch's changed values to the metrics log, stamped with the batch.

    A batch that is run again after a failure replaces what it had written.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    latest = latest_metrics(stream, order)
    return latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def current_metrics(log: DataFrame) -> DataFrame:
    """The state of a metrics log: for each metric of a step, the value of its last batch."""
    return log.groupBy("run", "step", "metric").agg(F.max_by("value", "batch").alias("value"))
