"""Comparison of the runs of each step, from samples to written reports."""

from pyspark.sql import DataFrame

from ..operators import runs
from ..session import saved_once
from ..sinks import writers


def compare_and_write(samples: DataFrame, root: str, by: str = "step", order: str = "sample_idx") -> DataFrame:
    """Compares runs on the first sample of each problem, writes the reports, returns the comparison."""
    results = runs.digested_results(samples, by, order)
    compared = saved_once(runs.compare_runs(results, by, runs.first_runs(samples, by)), "compared")
    summary = writers.comparison_summary(results, compared, by)
    documents = writers.difference_documents(samples, compared, by, order)
    writers.write_comparison(summary, documents, writers.prompt_documents(samples, compared, by, order), root, by)
    return compared
