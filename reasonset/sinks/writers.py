"""Writers. All of them write from the executors; nothing passes through the driver."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import fill, json_string
from ..operators.runs import CATEGORIES, comparison_counts, first_result, run_summary

def subset_metadata(
    stats: DataFrame, name: str, base_dataset: str, filters: dict, author: str = "", created_at: str | None = None
) -> DataFrame:
    """The one-row metadata record of a subset, from its row of statistics."""
    kinds = {"source": "string", "domain": "string", "max_tokens": "long", "max_assistant_tokens": "long", "limit": "long"}
    created = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return stats.select(
        F.lit(name).alias("name"),
        F.lit(author).alias("author"),
        created.alias("created_at"),
        F.lit(base_dataset).alias("base_dataset"),
        F.struct(*[F.lit(filters.get(k)).cast(kind).alias(k) for k, kind in kinds.items()]).alias("filters"),
        F.struct("total_rows", "avg_total_tokens", "avg_assistant_tokens").alias("stats"),
    )


def write_subsets(df: DataFrame, metadata: DataFrame, root: str) -> None:
    """Saves all subsets named in the ``subset`` column, with their metadata, in one job each.

    Rows are rebalanced by subset, so that a subset gets few files and a large one several. Other
    subsets below ``root`` stay as they are.
    """
    _replace_folders(df.hint("rebalance", "subset"), ["subset"]).parquet(f"{root}/dataset")
    _replace_folders(metadata, ["subset"]).option("ignoreNullFields", False).json(f"{root}/metadata")


def write_subset(
    df: DataFrame, root: str, name: str, metadata: DataFrame, samples: DataFrame | None = None, json_copy: bool = False
) -> None:
    """Saves one subset: its rows, its metadata record, and sample documents when given."""
    write_rows(df, root, name)
    write_metadata(metadata, root, name)
    if samples is not None:
        write_documents(samples, f"{root}/samples/subset={name}")
    if json_copy:
        _replace_folders(df.withColumn("subset", F.lit(name)), ["subset"]).json(f"{root}/json")


def write_rows(df: DataFrame, root: str, name: str) -> None:
    """The rows of one subset; its folder is replaced even by no rows."""
    df.write.mode("overwrite").parquet(f"{root}/dataset/{folder('subset', name)}")


def folder(column: str, value: str) -> str:
    """The folder of one value of a partition column, escaped as Spark does."""
    held = "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in value)
    return f"{column}={held or '__HIVE_DEFAULT_PARTITION__'}"


def write_metadata(metadata: DataFrame, root: str, name: str) -> None:
    named = metadata.withColumn("subset", F.lit(name))
    _replace_folders(named, ["subset"]).option("ignoreNullFields", False).json(f"{root}/metadata")


def _replace_folders(df: DataFrame, by: Sequence[str]) -> DataFrameWriter:
    """A writer that replaces the folders it has rows for, and no others."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)


def write_documents(documents: DataFrame, path: str, by: Sequence[str] = ("sample",), column: str = "document") -> None:
    """Text documents, one folder per key."""
    documents.select(*by, column).write.mode("overwrite").partitionBy(*by).text(path)


def stats_key(df: DataFrame, fields: Sequence[str] = ("difficulty_max", "difficulty_min", "domain", "source")) -> DataFrame:
    """Adds the key under which filtered statistics are kept: the MD5 of the filters as JSON.

    The text is sorted by field name, with a blank after each colon and comma, and missing values
    written as ``null``.
    """
    def value(field: str) -> Column:
        if df.schema[field].dataType.typeName() == "string":
            return json_string(F.col(field))
        return F.coalesce(F.col(field).cast("string"), F.lit("null"))

    members = [F.concat(F.lit(f'"{f}": '), value(f)) for f in sorted(fields)]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
    return df.withColumn("stats_key", F.md5(text))


def write_stats(stats: DataFrame, root: str, name: str = "stats") -> None:
    """Saves statistics or options, for a later session to look up."""
    stats.write.mode("overwrite").parquet(f"{root}/{name}")


def write_results(samples: DataFrame, root: str, order: str = "sample_idx") -> None:
    """Writes evaluation results as JSON lines, one folder per (config, run, eval, step).

    Takes one row per sample; all samples of a problem become one result, and the verdict and pass@k are those
    of the whole problem. Fields of the problem (prompt, target, difficulty, id) are written where samples carry them.
    Folders that get results are replaced; rows are rebalanced by folder, so that one gets few files.
    """
    sample = F.struct(
        F.col(order).alias("sample_idx"),
        F.col("response").alias("content"),
        F.col("answer").alias("extracted_answer"),
        F.col("is_correct"),
        F.col("error"),
    )
    keys = ["config", "run", "eval", "step"]
    stored = {"problem_id": "problem_id", "prompt": "prompt", "target": "correct_answer", "difficulty": "difficulty"}
    results = samples.groupBy(*keys, F.col("problem").alias("index")).agg(
        F.array_sort(F.collect_list(sample)).alias("samples"),
        F.bool_or("is_correct").alias("is_correct"),
        F.count(F.lit(1)).alias("pass_at_k"),
        *[F.max(c).alias(name) for c, name in stored.items() if c in samples.columns],
    )
    _replace_folders(results.hint("rebalance", *keys), keys).json(root)


def comparison_summary(results: DataFrame, compared: DataFrame, by: str = "step") -> DataFrame:
    """Per ``by`` value the text of a run comparison: one paragraph per run, then the counts."""
    def number(column: Column) -> Column:
        return column.cast("string")

    paragraph = fill(
        fixed.COMPARISON_RUN,
        run=F.col("run"),
        passed=number(F.col("passed")),
        failed=number(F.col("failed")),
        total=number(F.col("total")),
        percent=F.format_string("%.1f", F.bround(F.col("accuracy") * 100, 1)),
    )
    runs = (
        run_summary(results, [by, "run"])
        .groupBy(by)
        .agg(F.array_sort(F.collect_list(F.struct("run", paragraph.alias("text")))).alias("_runs"))
    )
    counts = runs.join(comparison_counts(compared, by), by, "left").fillna(0, CATEGORIES)

    content = fill(
        fixed.COMPARISON_SUMMARY,
        title=number(F.col(by)),
        runs=F.array_join(F.transform("_runs", lambda r: r["text"]), ""),
        flips=number(F.col("flip")),
        same=number(F.col("same_passed") + F.col("same_failed")),
        same_passed=number(F.col("same_passed")),
        same_failed=number(F.col("same_failed")),
    )
    return counts.select(by, content.alias("content"))


def _known(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column in df.columns else F.lit("")


def difference_documents(
    samples: DataFrame, compared: DataFrame, by: str = "step", order: str = "sample_idx"
) -> DataFrame:
    """One readable document per run of every problem that was not identical in all runs, with its answer and the correct one.

    Only the samples of those problems are looked at again for their texts. ``target`` of the samples is the correct answer.
    """
    differing = compared.filter(F.col("category") != "identical").select(by, "problem", "category")
    told = samples.withColumns({"response": _known(samples, "response"), "answer": _known(samples, "answer"), "correct": _known(samples, "target")})
    results = first_result(told.join(differing, [by, "problem"]), [by, "category", "problem", "run"], order, ["response", "answer", "correct"])
    status = F.when(F.col("is_correct"), "PASSED").otherwise("FAILED")
    document = fill(
        fixed.DIFFERENCE_DOCUMENT,
        problem=F.col("problem").cast("string"),
        run=F.col("run"),
        status=status,
        answer=F.col("answer"),
        correct=F.col("correct"),
        response=F.col("response"),
    )
    return results.select(by, "category", "problem", "run", status.alias("status"), "answer", "correct", document.alias("document"))


def prompt_documents(samples: DataFrame, compared: DataFrame, by: str = "step", order: str = "sample_idx") -> DataFrame:
    """The prompt of every problem that was not identical in all runs: that of the first run's first sample."""
    differing = compared.filter(F.col("category") != "identical").select(by, "problem", "category", F.col("first_run").alias("run"))
    asked = samples.select(by, "problem", "run", order, _known(samples, "prompt").alias("prompt"), F.lit(False).alias("is_correct"))
    first = first_result(asked.join(differing, [by, "problem", "run"]), [by, "category", "problem"], order, ["prompt"])
    document = fill(fixed.PROMPT_DOCUMENT, problem=F.col("problem").cast("string"), prompt=F.col("prompt"))
    return first.select(by, "category", "problem", document.alias("document"))


def flipped_questions(documents: DataFrame, by: str = "step") -> DataFrame:
    """From :func:`difference_documents`, one line per run of every question whose outcome differs between runs."""
    shown = F.when(F.col("status") == "PASSED", "✓ PASS").otherwise("✗ FAIL")
    line = fill(fixed.FLIP_LINE, run=F.col("run"), status=shown, answer=F.col("answer"), correct=F.col("correct"))
    return documents.filter(F.col("category") == "flip").select(by, "problem", "run", "status", "answer", "correct", line.alias("line"))


def write_comparison(summary: DataFrame, documents: DataFrame, prompts: DataFrame, root: str, by: str = "step") -> None:
    """Writes the summaries as texts, the documents and prompts by category, and the flipped questions of each ``by`` value.

    The questions are rows of a table next to the summary and not a part of its text, which would have to hold all of them.
    """
    spark = documents.sparkSession
    write_documents(summary, f"{root}/summary", [by], "content")
    folders = [by, "category"]
    _replace_folders(documents.hint("rebalance", *folders), folders).json(f"{root}/differences")
    _replace_folders(prompts.hint("rebalance", *folders), folders).json(f"{root}/prompts")
    written = spark.read.schema(documents.schema).json(f"{root}/differences")
    _replace_folders(flipped_questions(written, by).hint("rebalance", by), [by]).json(f"{root}/flips")


def catalog_report(catalog: DataFrame, prefix: str = "") -> DataFrame:
    """The catalogue as a report, in name order: one line per subset, and its figures."""
    def shown(field: str, default: str) -> Column:
        return F.coalesce(F.col(field).cast("string"), F.lit(default))

    average = F.format_string("%.1f", F.bround(F.coalesce("stats.avg_total_tokens", F.lit(0.0)), 1))
    report = catalog.select(
        F.replace(F.col("name"), F.lit(prefix), F.lit("")).alias("config_name") if prefix else F.col("name").alias("config_name"),
        F.col("name"),
        shown("base_dataset", "N/A").alias("base"),
        shown("filters.source", "all").alias("source"),
        shown("filters.max_tokens", "N/A").alias("max_tokens"),
        shown("stats.total_rows", "N/A").alias("rows"),
        average.alias("avg_tokens"),
    )
    columns = ["config_name", "base", "source", "max_tokens", "rows", "avg_tokens"]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |"))
    return report.withColumn("line", line).orderBy("name").select(*columns, "line")


def write_metrics(metrics: DataFrame, root: str) -> None:
    """Writes step metrics, one folder per run."""
    _replace_folders(metrics.hint("rebalance", "run"), ["run"]).parquet(root)
