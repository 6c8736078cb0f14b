"""Comparison of runs and steps, and step metrics."""

from pyspark.sql import functions as F

from reasonset.operators import metrics as metric_ops
from reasonset.operators import runs
from reasonset.sinks import writers
from reasonset.sources.results import parse_summaries as parse
from reasonset.sources.results import summary_table as leaderboard_of_texts

from . import views
from .registry import query
from .views import FIRST_RESULTS, METRICS, RESULTS

# Each problem of a step over all its runs; the first run is the reference.
_COMPARED = f"""WITH {FIRST_RESULTS}, firsts AS (SELECT step, min(run) AS first_run FROM first_results GROUP BY step),
 grouped AS (SELECT step, problem, count(*) AS n_runs, min(run) AS lowest, count(DISTINCT is_correct) AS outcomes,
  count(DISTINCT response) AS texts, bool_and(is_correct) AS passed,
  string_agg(concat(run, '=', response), ',' ORDER BY run) AS answers FROM first_results GROUP BY step, problem),
 compared AS (SELECT step, problem, n_runs, first_run, CASE WHEN outcomes > 1 THEN 'flip' WHEN texts = 1 THEN 'identical'
  WHEN passed THEN 'same_passed' ELSE 'same_failed' END AS category, answers
  FROM grouped JOIN firsts USING (step) WHERE n_runs >= 2 AND lowest = first_run)"""

_COUNTS = """counts AS (SELECT step, count(*) FILTER (category = 'flip') AS flip,
 count(*) FILTER (category = 'same_passed') AS same_passed, count(*) FILTER (category = 'same_failed') AS same_failed,
 count(*) FILTER (category = 'identical') AS identical, count(*) AS compared FROM compared GROUP BY step)"""

_RUNS = """runs AS (SELECT step, run, count(*) FILTER (is_correct) AS passed, count(*) AS total,
 round_even(count(*) FILTER (is_correct) / CAST(count(*) AS DOUBLE) * 100, 1) AS pct FROM first_results GROUP BY step, run)"""


def _compared(spark, sf_dir):
    firsts = runs.first_runs(views.samples(spark, sf_dir))
    return runs.compare_runs(views.first_results(spark, sf_dir), firsts=firsts)


@query(f"{_COMPARED} SELECT * FROM compared")
def compare_runs(spark, sf_dir):
    compared = _compared(spark, sf_dir)
    said = F.transform(F.map_entries("answers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return compared.withColumn("answers", F.array_join(said, ","))


@query(f"{_COMPARED}, {_COUNTS} SELECT * FROM counts")
def comparison_counts(spark, sf_dir):
    return runs.comparison_counts(_compared(spark, sf_dir))


@query(
    f"WITH {FIRST_RESULTS} SELECT step, run, count(*) FILTER (is_correct) AS passed, count(*) AS total,"
    " count(*) FILTER (NOT is_correct) AS failed, round(count(*) FILTER (is_correct) / CAST(count(*) AS DOUBLE), 9) AS accuracy"
    " FROM first_results GROUP BY step, run"
)
def run_summary(spark, sf_dir):
    found = runs.run_summary(views.first_results(spark, sf_dir), ["step", "run"])
    return found.withColumn("accuracy", F.round("accuracy", 9))


_BOARD = f"""{_COMPARED}, {_COUNTS}, {_RUNS}, spans AS (SELECT step, count(*) AS n_runs, min(pct) AS low, max(pct) AS high,
  arg_min(total, run) AS total FROM runs GROUP BY step),
 board AS (SELECT concat('m', s.step) AS model, CASE WHEN n_runs < 2 THEN 'N/A'
  WHEN low = high THEN concat(CAST(round_even(low, 0) AS BIGINT), '%')
  ELSE concat(CAST(round_even(low, 0) AS BIGINT), '-', CAST(round_even(high, 0) AS BIGINT), '%') END AS accuracy_range,
  coalesce(flip, 0) AS outcome_flips,
  (total - coalesce(flip + same_passed + same_failed, 0)) * 100.0E0 / total AS pct, total AS total_questions,
  total - coalesce(compared, 0) AS not_compared, s.step FROM spans s LEFT JOIN counts c ON s.step = c.step)"""


@query(
    f"{_BOARD} SELECT model, accuracy_range, outcome_flips, round(pct, 6) AS identical_pct, total_questions, not_compared,"
    " concat(repeat('█', CAST(trunc(pct / 100 * 50) AS BIGINT)), repeat('░', 50 - CAST(trunc(pct / 100 * 50) AS BIGINT))) AS chart"
    " FROM board"
)
def determinism_leaderboard(spark, sf_dir):
    model = F.concat(F.lit("m"), F.col("step").cast("string"))
    results = views.first_results(spark, sf_dir).withColumn("model", model)
    firsts = runs.first_runs(views.samples(spark, sf_dir).withColumn("model", model), "model")
    found = runs.determinism_leaderboard(results, "model", firsts)
    return found.withColumn("identical_pct", F.round("identical_pct", 6))


@query(
    f"{_BOARD}, same AS (SELECT step, same_passed + same_failed AS same_diff FROM counts)"
    " SELECT model, 'Full' AS model_type, accuracy_range, outcome_flips, round(pct, 6) AS identical_pct, total_questions"
    " FROM board"
)
def parse_summaries(spark, sf_dir):
    results = views.first_results(spark, sf_dir)
    texts = writers.comparison_summary(results, _compared(spark, sf_dir))
    named = texts.withColumn("model", F.concat(F.lit("m"), F.col("step").cast("string")))
    found = leaderboard_of_texts(parse(named))
    return found.withColumn("identical_pct", F.round("identical_pct", 6))


_STEPS = """steps AS (SELECT run, step, lag(step) OVER (PARTITION BY run ORDER BY step) AS prev_step
 FROM (SELECT DISTINCT run, step FROM results) s)"""

_DIFFED = f"""WITH {RESULTS}, {_STEPS}, has AS (SELECT DISTINCT run, eval, step FROM results),
 diffed AS (SELECT r.run, r.eval, r.step, r.problem, r.is_correct, s.prev_step,
  CASE WHEN h.step IS NULL THEN NULL WHEN p.problem IS NULL THEN 'new' WHEN r.is_correct AND NOT p.is_correct THEN 'new_pass'
   WHEN NOT r.is_correct AND p.is_correct THEN 'new_fail' ELSE 'same' END AS diff, h.step IS NOT NULL AS has_prev
  FROM results r JOIN steps s ON r.run = s.run AND r.step = s.step
  LEFT JOIN has h ON h.run = r.run AND h.eval = r.eval AND h.step = s.prev_step
  LEFT JOIN results p ON p.run = r.run AND p.eval = r.eval AND p.step = s.prev_step AND p.problem = r.problem)"""


@query(
    f"WITH {RESULTS}, found AS (SELECT DISTINCT concat('corpus_', problem % 9, '_s0.9_bs32_lr1e-05_e5_Org_Net') AS config, run"
    " FROM results) SELECT config, run, concat(substr(config, 8, 1), ' / ', run) AS label FROM found"
)
def list_runs(spark, sf_dir):
    config = F.concat(F.lit("corpus_"), (F.col("problem") % 9).cast("string"), F.lit("_s0.9_bs32_lr1e-05_e5_Org_Net"))
    return runs.list_runs(views.results(spark, sf_dir).withColumn("config", config), "corpus_")


@query(
    f"WITH {RESULTS}, s AS (SELECT run, step, string_agg(DISTINCT eval, ', ' ORDER BY eval) AS evals FROM results GROUP BY run, step)"
    " SELECT run, step, evals, concat('Step ', step, ' — ', evals) AS label FROM s"
)
def list_steps(spark, sf_dir):
    return runs.list_steps(views.results(spark, sf_dir))


@query(f"WITH {RESULTS}, {_STEPS} SELECT * FROM steps")
def previous_step(spark, sf_dir):
    return runs.previous_step(views.results(spark, sf_dir))


@query(f"{_DIFFED} SELECT run, eval, step, problem, is_correct, prev_step, diff FROM diffed")
def step_diff(spark, sf_dir):
    return runs.step_diff(views.results(spark, sf_dir))


@query(
    f"{_DIFFED} SELECT run, eval, step, problem, 'correct' AS mode FROM diffed WHERE is_correct UNION ALL"
    " SELECT run, eval, step, problem, 'incorrect' FROM diffed WHERE NOT is_correct UNION ALL"
    " SELECT run, eval, step, problem, 'newly_solved' FROM diffed WHERE diff = 'new_pass' UNION ALL"
    " SELECT run, eval, step, problem, 'newly_failed' FROM diffed WHERE diff = 'new_fail'"
)
def filter_results(spark, sf_dir):
    diffed = runs.step_diff(views.results(spark, sf_dir)).select("run", "eval", "step", "problem", "is_correct", "diff")
    found = None
    for mode in ("correct", "incorrect", "newly_solved", "newly_failed"):
        rows = runs.filter_results(diffed, mode).drop("is_correct", "diff").withColumn("mode", F.lit(mode))
        found = rows if found is None else found.unionByName(rows)
    return found


@query(
    f"{_DIFFED}, per_step AS (SELECT run, eval, step, any_value(prev_step) AS prev_step, count(*) AS total,"
    " count(*) FILTER (is_correct) AS correct, count(*) FILTER (diff = 'new_pass') AS newly_solved,"
    " count(*) FILTER (diff = 'new_fail') AS newly_failed FROM diffed GROUP BY run, eval, step)"
    " SELECT a.run, a.eval, a.step, a.prev_step, a.total, a.correct, a.newly_solved, a.newly_failed,"
    " round(a.correct / CAST(a.total AS DOUBLE), 9) AS accuracy, a.correct - b.correct AS delta_correct,"
    " round(a.correct / CAST(a.total AS DOUBLE) - b.correct / CAST(b.total AS DOUBLE), 9) AS delta_accuracy"
    " FROM per_step a LEFT JOIN per_step b ON a.run = b.run AND a.eval = b.eval AND a.prev_step = b.step"
)
def step_header(spark, sf_dir):
    found = runs.step_header(runs.step_diff(views.results(spark, sf_dir)))
    return found.withColumns({c: F.round(c, 9) for c in ("accuracy", "delta_accuracy")})


_MERGED = f"""WITH {METRICS}, merged AS (SELECT run, step, metric,
  coalesce(arg_max(value, seq) FILTER (late), arg_max(value, seq)) AS value FROM metrics GROUP BY run, step, metric)"""


def _merged(spark, sf_dir):
    rows = views.metrics(spark, sf_dir)
    return metric_ops.merge_metrics(rows.filter(~F.col("late")).drop("late"), rows.filter("late").drop("late"))


@query(f"{_MERGED} SELECT * FROM merged")
def merge_metrics(spark, sf_dir):
    return _merged(spark, sf_dir)


@query(
    f"{_MERGED} SELECT run, step, round(avg(value), 6) AS avg_value FROM merged WHERE lower(metric) LIKE '%accuracy%'"
    " GROUP BY run, step"
)
def mean_metric(spark, sf_dir):
    return metric_ops.mean_metric(_merged(spark, sf_dir)).withColumn("avg_value", F.round("avg_value", 6))
