"""What is written and read back: the tables go through files in the shared folder."""

from pyspark.sql import functions as F

from reasonset.operators import stats as stat_ops
from reasonset.plans.comparison import compare_and_write
from reasonset.session import shared_folder
from reasonset.sinks import writers
from reasonset.sources import saved
from reasonset.sources.results import explode_samples, read_problems as read_problem_files, read_results as read_result_files

from . import views
from .corpus import _BASIC, _CHOICES
from .registry import ORACLES, query
from .runs import _COMPARED, _MERGED, _merged, leaderboard_of_texts, parse
from .views import SAMPLES


def _stored_samples(spark, sf_dir):
    rows = views.samples(spark, sf_dir).withColumnRenamed("event_id", "sample_idx")
    return rows.select(
        "*", F.lit("corpus a").alias("config"), F.lit("code").alias("eval"), F.col("response").alias("answer"),
        F.lit("").alias("error"), F.concat(F.lit("item "), F.col("problem").cast("string")).alias("problem_id"),
        F.concat(F.lit("Solve "), F.col("problem").cast("string")).alias("prompt"),
        F.concat(F.lit("t"), F.col("problem").cast("string")).alias("target"), F.lit("easy").alias("difficulty"),
    )


@query(
    f"WITH {SAMPLES} SELECT 'corpus a' AS config, run, 'code' AS eval, step, problem, event_id AS sample_idx, response,"
    " response AS answer, is_correct, '' AS error, concat('item ', problem) AS problem_id, concat('Solve ', problem) AS prompt,"
    " concat('t', problem) AS target, 'easy' AS difficulty, count(*) OVER (PARTITION BY run, step, problem) AS pass_at_k FROM samples"
)
def read_results(spark, sf_dir):
    root = shared_folder(spark, "results")
    writers.write_results(_stored_samples(spark, sf_dir), root)
    return explode_samples(read_result_files(spark, root))


@query("SELECT CAST(item_id AS VARCHAR) AS answer, item_id AS id, text AS problem FROM benchmark")
def read_problems(spark, sf_dir):
    root = shared_folder(spark, "problems")
    stored = views.table(spark, sf_dir, "benchmark").withColumns(
        {"part": F.col("item_id") % 2, "answer": F.col("item_id")}
    )
    stored.write.partitionBy("part").json(root)
    fields = {"item_id": "id", "text": "problem", "answer": "answer"}
    schema = "item_id bigint, text string, answer bigint"
    return read_problem_files(spark, [f"{root}/part=0", f"{root}/part=1"], schema, fields)


# One subset per source; the source "src0" is described but has no rows left.
_SUBSETS = """subsets AS (SELECT source, concat('corpus_', source, '_t4096') AS name, count(*) AS total_rows,
  CAST(avg(length(text) // 4) AS DOUBLE) AS avg_total_tokens FROM documents GROUP BY source)"""


def _saved_subsets(spark, sf_dir):
    root = shared_folder(spark, "subsets")
    rows = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "source", "text", F.floor(F.length("text") / 4).alias("_total_tokens"),
        F.concat(F.lit("corpus_"), "source", F.lit("_t4096")).alias("subset"),
    )
    stats = rows.groupBy("subset", "source").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.avg("_total_tokens").alias("avg_total_tokens"),
        F.lit(0.0).alias("avg_assistant_tokens"),
    )
    null_long = F.lit(None).cast("long")
    metadata = stats.select(
        "subset", F.col("subset").alias("name"), F.lit("").alias("author"), F.lit("").alias("created_at"),
        F.lit("documents").alias("base_dataset"),
        F.struct(
            "source", F.lit("all").alias("domain"), F.lit(4096).cast("long").alias("max_tokens"),
            null_long.alias("max_assistant_tokens"), null_long.alias("limit"),
        ).alias("filters"),
        F.struct("total_rows", "avg_total_tokens", "avg_assistant_tokens").alias("stats"),
    )
    writers.write_subsets(rows.filter(F.col("source") != "src0"), metadata, root)
    return root


@query(
    f"WITH {_SUBSETS} SELECT name AS subset, source, total_rows, round(avg_total_tokens, 6) AS avg_total_tokens,"
    " 4096 AS max_tokens FROM subsets WHERE source <> 'src0'"
)
def subset_catalog(spark, sf_dir):
    catalog = saved.read_catalog(spark, _saved_subsets(spark, sf_dir))
    return catalog.select(
        "subset", "filters.source", "stats.total_rows", F.round("stats.avg_total_tokens", 6).alias("avg_total_tokens"),
        F.col("filters.max_tokens").cast("int").alias("max_tokens"),
    )


@query(
    f"WITH {_SUBSETS}, r AS (SELECT replace(name, 'corpus_', '') AS config_name, 'documents' AS base, source, '4096' AS max_tokens,"
    " CAST(total_rows AS VARCHAR) AS \"rows\", format('{:.1f}', round_even(avg_total_tokens, 1)) AS avg_tokens FROM subsets"
    " WHERE source <> 'src0') SELECT *, concat('| ', concat_ws(' | ', config_name, base, source, max_tokens, \"rows\", avg_tokens),"
    " ' |') AS line FROM r"
)
def catalog_report(spark, sf_dir):
    return writers.catalog_report(saved.read_catalog(spark, _saved_subsets(spark, sf_dir)), "corpus_")


@query("SELECT doc_id AS id, text, length(text) // 4 AS total_tokens FROM documents WHERE source = 'src7'")
def write_subset(spark, sf_dir):
    root = _saved_subsets(spark, sf_dir)
    subset = saved.read_subset(spark, root, "corpus_src7_t4096")
    return subset.select("id", "text", F.col("_total_tokens").alias("total_tokens"))


_FILTERS = """f AS (SELECT doc_id AS id, source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS domain,
  CAST(n_chars AS BIGINT) AS difficulty_min, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE doc_id END AS difficulty_max FROM documents)"""


@query(
    f"WITH {_FILTERS} SELECT id, md5(concat('{{\"difficulty_max\": ', coalesce(CAST(difficulty_max AS VARCHAR), 'null'),"
    " ', \"difficulty_min\": ', difficulty_min, ', \"domain\": ', CASE WHEN domain IS NULL THEN 'null' ELSE"
    " concat('\"', domain, '\"') END, ', \"source\": \"', source, '\"}')) AS stats_key FROM f"
)
def stats_key(spark, sf_dir):
    key = F.col("doc_id")
    filters = views.table(spark, sf_dir, "documents").select(
        key.alias("id"),
        "source",
        F.when(key % 3 != 0, F.col("lang")).alias("domain"),
        F.col("n_chars").alias("difficulty_min"),
        F.when(key % 2 != 0, key).alias("difficulty_max"),
    )
    return writers.stats_key(filters).select("id", "stats_key")


@query(
    f"{_CHOICES}, found AS (SELECT wanted_source, wanted_domain, {_BASIC} FROM matched GROUP BY 1, 2)"
    " SELECT p.source, p.domain, coalesce(total_rows, 0) AS total_rows, avg_difficulty FROM pairs p LEFT JOIN found f"
    " ON p.source = f.wanted_source AND p.domain = f.wanted_domain"
)
def write_stats(spark, sf_dir):
    root = shared_folder(spark, "stats")
    writers.write_stats(stat_ops.stats_cube_maps(views.conv_examples(spark, sf_dir)), root)
    read = saved.read_stats(spark, root)
    return read.select("source", "domain", "total_rows", F.round("avg_difficulty", 6).alias("avg_difficulty"))


_DIMENSIONS = {"difficulty": "coalesce(CAST(difficulty AS VARCHAR), 'None')", "source": "coalesce(source, 'null')", "domain": "coalesce(domain, 'null')"}
_MAPS = ", ".join(
    f"{name}_map AS (SELECT s, d, string_agg(concat(k, '=', n), ',' ORDER BY k) AS {name}_distribution FROM"
    f" (SELECT wanted_source AS s, wanted_domain AS d, {key} AS k, count(*) AS n FROM matched GROUP BY ALL) g GROUP BY s, d)"
    for name, key in _DIMENSIONS.items()
)

_SHOWN = ", ".join(f"coalesce({name}_distribution, '') AS {name}_distribution" for name in _DIMENSIONS)


@query(
    f"{_CHOICES}, {_MAPS} SELECT p.source, p.domain, {_SHOWN} FROM pairs p"
    + "".join(f" LEFT JOIN {n}_map ON p.source = {n}_map.s AND p.domain = {n}_map.d" for n in _DIMENSIONS)
)
def read_stats_maps(spark, sf_dir):
    """The distributions of every choice, written as maps and read back, as text in key order."""
    root = shared_folder(spark, "stats")
    writers.write_stats(stat_ops.stats_cube_maps(views.conv_examples(spark, sf_dir)), root)

    def shown(name):
        entries = F.array_sort(F.map_entries(f"{name}_distribution"))
        return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(f"{name}_distribution")

    return saved.read_stats(spark, root).select("source", "domain", *[shown(n) for n in _DIMENSIONS])


@query(f"{_MERGED} SELECT run, step, metric, value FROM merged")
def write_metrics(spark, sf_dir):
    root = shared_folder(spark, "metrics")
    writers.write_metrics(_merged(spark, sf_dir), root)
    return saved.read_metrics(spark, root).select("run", "step", "metric", "value")


_STATUS = "CASE WHEN r.is_correct THEN 'PASSED' ELSE 'FAILED' END"
_DIFFERING = "FROM first_results r JOIN compared c ON r.step = c.step AND r.problem = c.problem WHERE c.category"


def _written_comparison(spark, sf_dir):
    root = shared_folder(spark, "comparison")
    problem = F.col("problem").cast("string")
    told = {"answer": F.col("response"), "target": F.concat(F.lit("t"), problem), "prompt": F.concat(F.lit("Solve "), problem)}
    compare_and_write(views.samples(spark, sf_dir).withColumns(told), root, order="event_id")
    return root


@query(
    f"{_COMPARED} SELECT r.step, c.category, r.problem, r.run, {_STATUS} AS status,"
    f" concat('Question Index: ', r.problem, chr(10), 'Timestamp: ', r.run, chr(10), 'Status: ', {_STATUS}, chr(10), 'Extracted Answer: ', r.response,"
    f" chr(10), 'Correct Answer: t', r.problem, chr(10), chr(10), 'RESPONSE:', chr(10), r.response, chr(10)) AS document {_DIFFERING} <> 'identical'"
)
def write_comparison(spark, sf_dir):
    schema = "problem bigint, run string, status string, document string, step bigint, category string"
    return spark.read.schema(schema).json(f"{_written_comparison(spark, sf_dir)}/differences")


@query(
    f"{_COMPARED} SELECT r.step, r.problem, r.run, {_STATUS} AS status, r.response AS answer, concat('t', r.problem) AS correct,"
    " concat(r.run, ': ', CASE WHEN r.is_correct THEN '✓ PASS' ELSE '✗ FAIL' END, ' (answered: ', r.response, ', correct: t', r.problem, ')') AS line"
    f" {_DIFFERING} = 'flip'"
)
def comparison_flips(spark, sf_dir):
    schema = "problem bigint, run string, status string, answer string, correct string, line string, step bigint"
    return spark.read.schema(schema).json(f"{_written_comparison(spark, sf_dir)}/flips")


@query(
    f"{_COMPARED} SELECT step, category, problem, concat('Question Index: ', problem, chr(10), chr(10), 'PROMPT:', chr(10), 'Solve ', problem, chr(10)) AS document"
    " FROM compared WHERE category <> 'identical'"
)
def comparison_prompts(spark, sf_dir):
    schema = "problem bigint, document string, step bigint, category string"
    return spark.read.schema(schema).json(f"{_written_comparison(spark, sf_dir)}/prompts")


@query(ORACLES["parse_summaries"])
def read_comparison_summaries(spark, sf_dir):
    """The figures of the written summaries, read back from their files."""
    read = spark.read.text(f"{_written_comparison(spark, sf_dir)}/summary", wholetext=True)
    named = read.select(F.concat(F.lit("m"), F.col("step").cast("string")).alias("model"), F.col("value").alias("content"))
    found = leaderboard_of_texts(parse(named))
    return found.withColumn("identical_pct", F.round("identical_pct", 6))
