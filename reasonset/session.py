"""Session settings and the shared folder for written intermediate tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "reasonset", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on; ``conf`` adds to or replaces them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        # Re-plan at run time: merge small shuffle partitions, split skewed join partitions,
        # and turn a join into a broadcast only when the measured side is below the threshold.
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session may do without that setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="reasonset-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved_once(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back.

    For a narrow table that is derived from much wider rows and used more than once: the rows are
    then read once for it, and a lost executor costs a re-read of files instead of a recomputation.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
