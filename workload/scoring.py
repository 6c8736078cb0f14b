"""Scoring of samples, and rewards."""

from pyspark.sql import functions as F

from reasonset.operators import position, rewards, scoring
from reasonset.plans import scoring as plan
from reasonset.session import saved_once

from . import views
from .registry import query
from .views import REWARDS, SAMPLES

_PROBLEMS = "problems AS (SELECT c_custkey AS problem, c_name AS name FROM customer)"


def _problems(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("problem"), F.col("c_name").alias("name"))


@query(
    f"WITH {SAMPLES}, {_PROBLEMS} SELECT problem, name, event_id, coalesce(is_correct, false) AS is_correct,"
    " CASE WHEN event_id IS NULL THEN 'No response' ELSE '' END AS error FROM problems LEFT JOIN samples USING (problem)"
)
def attach_samples(spark, sf_dir):
    samples = views.samples(spark, sf_dir).select("problem", "event_id", "is_correct")
    return scoring.attach_samples(_problems(spark, sf_dir), samples)


@query(
    f"WITH {SAMPLES} SELECT run, step, problem, count(*) AS k, bool_or(is_correct) AS is_correct FROM samples"
    " GROUP BY run, step, problem"
)
def pass_at_k(spark, sf_dir):
    return scoring.pass_at_k(views.samples(spark, sf_dir), ["run", "step", "problem"])


@query(
    f"WITH {SAMPLES}, {_PROBLEMS}, solved AS (SELECT run, step, problem, bool_or(is_correct) AS ok,"
    " problem IN (SELECT problem FROM problems) AS inside FROM samples GROUP BY run, step, problem)"
    " SELECT run, step, count(*) FILTER (ok AND inside) AS n_correct, count(*) FILTER (inside) AS n_answered,"
    " (SELECT count(*) FROM problems) AS n_problems,"
    " round(count(*) FILTER (ok AND inside) / CAST((SELECT count(*) FROM problems) AS DOUBLE), 9) AS accuracy FROM solved GROUP BY run, step"
)
def accuracy(spark, sf_dir):
    found = scoring.accuracy(_problems(spark, sf_dir), views.samples(spark, sf_dir), ["run", "step"])
    return found.withColumn("accuracy", F.round("accuracy", 9))


# Every third customer is a multiple-choice problem, the others have a number for an answer. An event is a sample whose
# text boxes its answer, names it in a last line, or gives none.
_EVAL = "CASE WHEN {0} % 3 = 0 THEN 'choice' ELSE 'math' END"


@query(
    f"""WITH {SAMPLES}, {_PROBLEMS}, solved AS (SELECT run, step, {_EVAL.format("problem")} AS eval, problem,
  bool_or(problem IN (SELECT problem FROM problems) AND event_id % 5 <> 0 AND CASE WHEN problem % 3 = 0
   THEN event_id % 2 = 0 AND event_id % 4 = problem % 4 ELSE event_id % 7 = problem % 7 END) AS ok FROM samples GROUP BY ALL),
 sizes AS (SELECT {_EVAL.format("problem")} AS eval, count(*) AS n FROM problems GROUP BY 1)
 SELECT run, step, concat(eval, '_pass@4') AS metric, round(count(*) FILTER (ok) / CAST(any_value(n) AS DOUBLE), 9) AS value
 FROM solved JOIN sizes USING (eval) GROUP BY run, step, eval"""
)
def score_samples(spark, sf_dir):
    which = F.expr(_EVAL.format("problem")).alias("eval")
    letter = lambda n: F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (n % 4 + 1).cast("int"))
    choice, number = F.col("problem") % 3 == 0, lambda n: (n % 7).cast("string")
    problems = _problems(spark, sf_dir).select(
        which,
        "problem",
        F.when(choice, letter(F.col("problem"))).otherwise(number(F.col("problem"))).alias("target"),
        F.when(choice, F.lit(plan.LETTER)).otherwise(F.lit(plan.ANSWER)).alias("kind"),
    )
    said = F.when(choice, letter(F.col("event_id"))).otherwise(number(F.col("event_id")))
    content = (
        F.when(F.col("event_id") % 5 == 0, F.lit("no idea"))
        .when(F.col("event_id") % 2 == 0, F.concat(F.lit(r"so it is \boxed{"), said, F.lit("}.")))
        .otherwise(F.concat(F.lit("so it is\nANSWER: "), said))
    )
    samples = views.samples(spark, sf_dir).select("run", "step", which, "problem", content.alias("content"))
    return plan.score_samples(samples, problems, k=4).withColumn("value", F.round("value", 9))


# Tests: an order priority is a problem with one or three tests; an order is a sample, its lines
# are test results. Samples are numbered anew in each problem, as evaluations number them.
_N_TESTS = "length(o_orderpriority) % 3 + 1"
_VERDICT = f"""WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS nr FROM orders), tests AS (SELECT DISTINCT o_orderpriority AS problem, unnest(range(1, {_N_TESTS} + 1)) AS test FROM orders),
 results AS (SELECT l_orderkey AS sample, l_linenumber AS test, bool_and(l_linestatus = 'O') AS passed FROM lineitem GROUP BY 1, 2),
 joined AS (SELECT o.o_orderpriority AS problem, o.nr AS sample, t.test, coalesce(r.passed, false) AS passed
  FROM numbered o LEFT JOIN tests t ON t.problem = o.o_orderpriority LEFT JOIN results r ON r.sample = o.o_orderkey AND r.test = t.test)
 SELECT problem, sample, count(*) FILTER (passed) AS n_passed, count(test) AS n_tests,
  count(*) FILTER (passed) = count(test) AS is_correct FROM joined GROUP BY problem, sample"""


@query(_VERDICT)
def sample_verdict(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("problem"))
    numbered = position.with_position(orders, [F.col("o_orderkey")], [position.range_bucket(orders, "o_orderkey")], by=["problem"], name="sample")
    # Written once: it names the samples, their problems' tests and their results.
    numbered = saved_once(numbered, "numbered")
    samples = numbered.select("problem", "sample")
    kinds = samples.select("problem").distinct()
    tests = kinds.select("problem", F.explode(F.sequence(F.lit(1), F.length("problem") % 3 + 1)).alias("test"))
    lines = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_linenumber").alias("test"),
        (F.col("l_linestatus") == "O").alias("passed"),
    )
    return scoring.sample_verdict(samples, tests, lines.join(numbered, "o_orderkey"))


@query(
    "WITH v AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings)"
    " SELECT round(sum(CASE WHEN pos >= label THEN abs(CAST(x AS DOUBLE)) ELSE 0.0E0 END)"
    " / sum(CASE WHEN pos >= label THEN 1.0E0 ELSE 0.0E0 END), 6) AS nll FROM v"
)
def mean_nll(spark, sf_dir):
    found = scoring.mean_nll(_token_records(spark, sf_dir))
    return found.withColumn("nll", F.round("nll", 6))


def _token_records(spark, sf_dir):
    return views.table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 32).alias("step"),
        F.col("embedding").alias("tokens"),
        F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("logprobs"),
        F.transform("embedding", lambda _, i: (i >= F.col("label")).cast("double")).alias("weights"),
    )


@query(
    "SELECT CAST(vec_id // 32 AS BIGINT) AS step, count(*) AS num_sequences, CAST(sum(len(embedding)) AS BIGINT) AS num_tokens,"
    " CAST(sum(greatest(len(embedding) - label, 0)) AS DOUBLE) AS num_loss_tokens FROM embeddings GROUP BY 1"
)
def batch_counters(spark, sf_dir):
    return scoring.batch_counters(_token_records(spark, sf_dir))


@query(
    f"WITH {REWARDS}, m AS (SELECT *, avg(reward) OVER (PARTITION BY question) AS mean, min(reward) OVER (PARTITION BY question)"
    " AS low, max(reward) OVER (PARTITION BY question) AS high FROM rewards)"
    " SELECT question, sample, reward, round(reward - mean, 6) AS advantage FROM m WHERE low <> high"
)
def group_advantage(spark, sf_dir):
    found = rewards.group_advantage(views.rewards(spark, sf_dir))
    return found.withColumn("advantage", F.round("advantage", 6))


@query(
    f"WITH {REWARDS} SELECT count(*) AS n, round(avg(reward), 6) AS mean_reward, round(stddev_samp(reward), 6) AS std_reward"
    " FROM rewards"
)
def reward_stats(spark, sf_dir):
    found = rewards.reward_stats(views.rewards(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_reward", "std_reward")})


@query(
    f"WITH {REWARDS}, q AS (SELECT question, avg(reward) AS mean FROM rewards GROUP BY question)"
    " SELECT count(*) AS n_questions, round(avg(mean), 6) AS batch_reward FROM q"
)
def batch_reward(spark, sf_dir):
    found = rewards.batch_reward(views.rewards(spark, sf_dir))
    return found.withColumn("batch_reward", F.round("batch_reward", 6))
