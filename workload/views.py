"""The given tables seen as a reasoning corpus, as DataFrames and as the same views in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reasonset.functions.text import WHITESPACE
from reasonset.operators.runs import digested_results


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its files are asked for their schema the first time only."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# Documents as examples: a dense corpus in which every source has every domain.
EXAMPLES = """examples AS (
  SELECT d.doc_id AS id, d.source, d.lang AS domain, l.quality AS difficulty, d.text, d.n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("difficulty"))
    documents = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return documents.select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("domain"), "difficulty", "text", "n_chars")


# Conversations as examples: the source fixes the domain, so that some pairs are empty.
CONV_EXAMPLES = """conv_examples AS (
  SELECT conv_id AS id, concat('src', conv_id % 5) AS source,
         CASE WHEN conv_id % 5 = 0 THEN 'math' WHEN conv_id % 5 IN (1, 2) THEN 'code' ELSE 'science' END AS domain,
         CASE WHEN conv_id % 5 IN (1, 2) THEN 6 + conv_id % 4 END AS difficulty
  FROM conversations GROUP BY conv_id)"""


def conv_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id")).distinct()
    kind = F.col("id") % 5
    return ids.select(
        "id",
        F.concat(F.lit("src"), kind.cast("string")).alias("source"),
        F.when(kind == 0, "math").when(kind.isin(1, 2), "code").otherwise("science").alias("domain"),
        F.when(kind.isin(1, 2), 6 + F.col("id") % 4).alias("difficulty"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "id")


# Assistant turns with the three reasoning tag styles, without any, and with a doubled one.
MARKED_TURNS = """marked_turns AS (
  SELECT conv_id AS id, turn, role,
         CASE WHEN role <> 'assistant' THEN text
              WHEN conv_id % 5 = 1 THEN concat('<think>', substr(text, 1, 20), '</think>', substr(text, 21))
              WHEN conv_id % 5 = 2 THEN concat('<thinking>', substr(text, 1, 20), '</thinking>', substr(text, 21))
              WHEN conv_id % 5 = 3 THEN concat('<|thinking|>', substr(text, 1, 20), '<|/thinking|>', substr(text, 21))
              WHEN conv_id % 5 = 4 THEN concat('pre <think>', substr(text, 1, 5), '</think> mid <think>',
                                               substr(text, 6, 5), '</think>', substr(text, 11))
              ELSE text END AS text
  FROM conversations)"""


def marked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")

    def part(start: int, length: int | None = None):
        return F.substr(text, F.lit(start), F.lit(length)) if length else F.substr(text, F.lit(start))

    def put(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    kind = F.col("id") % 5
    marked = (
        F.when(F.col("role") != "assistant", text)
        .when(kind == 1, put("<think>", part(1, 20), "</think>", part(21)))
        .when(kind == 2, put("<thinking>", part(1, 20), "</thinking>", part(21)))
        .when(kind == 3, put("<|thinking|>", part(1, 20), "<|/thinking|>", part(21)))
        .when(kind == 4, put("pre <think>", part(1, 5), "</think> mid <think>", part(6, 5), "</think>", part(11)))
        .otherwise(text)
    )
    return turns(spark, sf_dir).withColumn("text", marked)


# Events as stored samples of five runs at six steps; a problem has several samples.
SAMPLES = """samples AS (
  SELECT event_type AS run, CAST(floor((day(ts) - 1) / 5) * 5 AS BIGINT) AS step, user_id AS problem, event_id,
         value >= 100 AS is_correct, regexp_extract(props, '([0-9]+)', 1) AS response
  FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"),
        (F.floor((F.day("ts") - 1) / 5) * 5).cast("long").alias("step"),
        F.col("user_id").alias("problem"),
        "event_id",
        (F.col("value") >= 100).alias("is_correct"),
        F.regexp_extract("props", "([0-9]+)", 1).alias("response"),
    )


# One result per run, step and problem, with the first sample's response.
FIRST_RESULTS = (
    SAMPLES
    + """, first_results AS (
  SELECT run, step, problem, bool_or(is_correct) AS is_correct, arg_min(response, event_id) AS response
  FROM samples GROUP BY run, step, problem)"""
)


def first_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested_results(samples(spark, sf_dir).withColumn("answer", F.col("response")), order="event_id")


# Results of two evals, one of which is missing at every other step.
RESULTS = (
    SAMPLES
    + """, results AS (
  SELECT run, CASE WHEN problem % 3 = 0 AND step % 10 = 0 THEN 'choice' ELSE 'code' END AS eval, step, problem,
         bool_or(is_correct) AS is_correct
  FROM samples GROUP BY run, step, problem)"""
)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = samples(spark, sf_dir).groupBy("run", "step", "problem").agg(F.bool_or("is_correct").alias("is_correct"))
    choice = (F.col("problem") % 3 == 0) & (F.col("step") % 10 == 0)
    return solved.withColumn("eval", F.when(choice, "choice").otherwise("code"))


# Model texts in five answer styles, with targets.
ANSWERS = """answers AS (
  SELECT event_id,
         CASE WHEN event_id % 5 = 0 THEN concat('so ', chr(92), 'boxed{', k, '}')
              WHEN event_id % 5 = 1 THEN concat(chr(92), 'boxed{1} then ', chr(92), 'boxed{', chr(92), 'text{', k, '}}')
              WHEN event_id % 5 = 2 THEN concat('answer: $0,', k, chr(10), 'done')
              WHEN event_id % 5 = 3 THEN concat('just ', k)
              ELSE concat(chr(92), 'boxed{', chr(65 + CAST(event_id % 4 AS INT)), '}') END AS content,
         CASE WHEN event_id % 3 = 0 THEN k ELSE CAST(user_id % 100 AS VARCHAR(10)) END AS target
  FROM (SELECT event_id, user_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM events) e)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1)
    style = F.col("event_id") % 5
    letter = F.substr(F.lit("ABCD"), (F.col("event_id") % 4 + 1).cast("int"), F.lit(1))
    content = (
        F.when(style == 0, F.concat(F.lit("so \\boxed{"), k, F.lit("}")))
        .when(style == 1, F.concat(F.lit("\\boxed{1} then \\boxed{\\text{"), k, F.lit("}}")))
        .when(style == 2, F.concat(F.lit("answer: $0,"), k, F.lit("\ndone")))
        .when(style == 3, F.concat(F.lit("just "), k))
        .otherwise(F.concat(F.lit("\\boxed{"), letter, F.lit("}")))
    )
    target = F.when(F.col("event_id") % 3 == 0, k).otherwise((F.col("user_id") % 100).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", content.alias("content"), target.alias("target"), k.alias("k"))


# Rewards of sampled answers: a question is an order.
REWARDS = """rewards AS (
  SELECT l_orderkey AS question, l_linenumber AS sample,
         CASE WHEN l_returnflag = 'R' THEN 1.0E0 ELSE 0.0E0 END AS reward
  FROM lineitem)"""


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("question"),
        F.col("l_linenumber").alias("sample"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("reward"),
    )


# Logged step metrics, half of them late.
METRICS = """metrics AS (
  SELECT event_type AS run, CAST(day(ts) AS BIGINT) AS step,
         CASE user_id % 4 WHEN 0 THEN 'eval/math_accuracy' WHEN 1 THEN 'eval/CHOICE_Accuracy'
                          WHEN 2 THEN 'test/nll' ELSE 'train_mean_nll' END AS metric,
         value, event_id AS seq, event_id % 2 = 1 AS late
  FROM events)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("user_id") % 4
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"),
        F.day("ts").cast("long").alias("step"),
        F.when(kind == 0, "eval/math_accuracy")
        .when(kind == 1, "eval/CHOICE_Accuracy")
        .when(kind == 2, "test/nll")
        .otherwise("train_mean_nll")
        .alias("metric"),
        "value",
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 2 == 1).alias("late"),
    )


# Choice questions: a part and its brand among three other texts, which may repeat it.
CHOICES = """choices AS (
  SELECT p_partkey AS id, concat('Which brand makes ', p_name, ' ', p_partkey, '?') AS question, p_brand AS correct,
         p_type AS wrong1, p_name AS wrong2, CASE WHEN p_size % 7 = 0 THEN p_brand ELSE concat('Brand#', p_size) END AS wrong3
  FROM part)"""


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("p_size") % 7 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("Brand#"), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("Which brand makes "), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.lit("?")).alias("question"),
        F.col("p_brand").alias("correct"),
        F.array("p_brand", "p_type", "p_name", other).alias("options"),
    )


# Rows to be ordered for training, each with a difficulty.
TRAIN = "train AS (SELECT event_id AS id, 6 + user_id % 5 AS difficulty FROM events)"


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (6 + F.col("user_id") % 5).alias("difficulty"))


# The characters that str.strip() removes, as an SQL expression.
BLANKS = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def stripped(sql: str) -> str:
    return f"trim({sql}, {BLANKS})"
