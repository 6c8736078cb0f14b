"""Reading back what was saved: subsets, their catalogue, statistics and metrics."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = (
    "name string, author string, created_at string, base_dataset string, "
    "filters struct<source:string,domain:string,max_tokens:bigint,max_assistant_tokens:bigint,`limit`:bigint>, "
    "stats struct<total_rows:bigint,avg_total_tokens:double,avg_assistant_tokens:double>"
)


def _saved(path: str, read) -> DataFrame | None:
    """The table at ``path``, or nothing when it was never saved."""
    try:
        return read(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_subset(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    return _saved(f"{root}/dataset/subset={name}", spark.read.parquet)


def read_stats(spark: SparkSession, root: str, name: str = "stats") -> DataFrame | None:
    """Saved statistics or options."""
    return _saved(f"{root}/{name}", spark.read.parquet)


def read_metrics(spark: SparkSession, root: str) -> DataFrame | None:
    return _saved(root, spark.read.parquet)


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    """The metadata of every subset below ``root`` that has a dataset."""
    meta = spark.read.schema(METADATA + ", subset string").json(f"{root}/metadata")
    # Only names are listed here: the content column is not asked for, so no file is opened.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{root}/dataset")
    folder = F.regexp_extract("path", "/subset=([^/]+)/", 1)
    stored = files.select(F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))).alias("subset")).distinct()
    return meta.join(stored, "subset", "left_semi")
