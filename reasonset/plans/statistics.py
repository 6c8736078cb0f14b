"""Statistics for all choices, computed once and looked up afterwards."""

from pyspark.sql import DataFrame

from ..operators import stats
from ..sinks.writers import write_stats
from ..sources.saved import read_stats


def precompute(df: DataFrame, root: str, force: bool = False) -> DataFrame:
    """Saves options and the statistics of every choice; keeps what is there unless ``force``."""
    spark = df.sparkSession
    saved = read_stats(spark, root)
    if saved is not None and not force:
        return saved
    counts = stats.counted(df)
    write_stats(stats.options_of(counts), root, "options")
    write_stats(stats.stats_cube_maps(df, read_stats(spark, root, "options"), counts), root)
    return read_stats(spark, root)
