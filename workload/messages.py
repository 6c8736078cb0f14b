"""Messages, texts, names and prompts: expressions over whole tables."""

from pyspark.sql import functions as F

from reasonset.functions import answers, arrays, fixed, names, prompts, text
from reasonset.operators import turns as turn_ops
from reasonset.sources.corpus import decode_messages as decode

from . import views
from .registry import query
from .views import BLANKS, CHOICES, MARKED_TURNS, stripped


@query("SELECT conv_id AS id, turn, role, text FROM conversations")
def decode_messages(spark, sf_dir):
    # Each turn is stored in one of the two key styles; a conversation may mix them.
    turns = views.turns(spark, sf_dir)
    plain = F.to_json(F.struct(F.col("role"), F.col("text").alias("content")))
    other = F.to_json(F.struct(F.col("role").alias("from"), F.col("text").alias("value")))
    stored = turns.withColumn("text", F.when((F.col("id") + F.col("turn")) % 2 == 0, plain).otherwise(other))
    nested = turn_ops.nest_turns(stored)
    parts = F.transform("messages", lambda m: m["text"])
    as_json = nested.withColumn("conversations", F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]")))
    found = decode(as_json).select("id", F.posexplode("messages").alias("turn", "m"))
    return found.select("id", F.col("turn").cast("long").alias("turn"), F.col("m.role").alias("role"), F.col("m.text").alias("text"))


@query(
    "SELECT conv_id AS id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles,"
    " string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1"
)
def nest_turns(spark, sf_dir):
    return turn_ops.nest_turns(views.turns(spark, sf_dir)).select(
        "id",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.array_join(F.transform("messages", lambda m: m["text"]), "\n").alias("body"),
    )


@query(
    "WITH m AS (SELECT conv_id AS id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text"
    " FROM conversations) SELECT *, coalesce(turn = max(turn) FILTER (role = 'assistant') OVER (PARTITION BY id), false)"
    " AS is_target FROM m"
)
def mark_target(spark, sf_dir):
    return turn_ops.mark_target(views.turns(spark, sf_dir))


_THINK = "strpos(text, '<think>') > 0 AND strpos(text, '</think>') > 0"


@query(
    f"WITH {MARKED_TURNS} SELECT id, turn, CASE WHEN {_THINK} THEN "
    + stripped("regexp_extract(text, '(?s)<think>(.*?)</think>', 1)")
    + f" ELSE '' END AS reasoning, CASE WHEN {_THINK} THEN "
    + stripped("regexp_extract(text, '(?s)<think>.*?</think>(.*)$', 1)")
    + f" ELSE {stripped('text')} END AS output FROM marked_turns"
)
def split_reasoning(spark, sf_dir):
    split = text.split_reasoning(F.col("text"))
    return views.marked_turns(spark, sf_dir).withColumn("s", split).select("id", "turn", "s.*")


def _multi_sql():
    styles = [("<think>", "</think>"), (r"<\|thinking\|>", r"<\|/thinking\|>"), ("<thinking>", "</thinking>")]
    reasoning, response = "CASE", "CASE"
    for opening, closing in styles:
        found = f" WHEN regexp_matches(text, '(?s){opening}.*?{closing}') THEN "
        reasoning += found + stripped(f"regexp_extract(text, '(?s){opening}(.*?){closing}', 1)")
        response += found + stripped(f"regexp_replace(text, '(?s){opening}.*?{closing}', '', 'g')")
    return (
        f"WITH {MARKED_TURNS} SELECT id, turn, {reasoning} ELSE NULL END AS reasoning, {response} ELSE text END AS response"
        " FROM marked_turns"
    )


@query(_multi_sql())
def split_reasoning_multi(spark, sf_dir):
    split = text.split_reasoning_multi(F.col("text"))
    return views.marked_turns(spark, sf_dir).withColumn("s", split).select("id", "turn", "s.*")


_ONE_LINE = stripped("replace(text, chr(10), ' ')")


@query(
    f"SELECT doc_id AS id, CASE WHEN length({_ONE_LINE}) > 80 THEN concat(substr({_ONE_LINE}, 1, 80), '...')"
    f" ELSE {_ONE_LINE} END AS brief FROM documents"
)
def brief(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents")
    return documents.select(F.col("doc_id").alias("id"), text.brief(F.col("text")).alias("brief"))


# ---------------------------------------------------------------- names

_NAME_PARTS = """parts AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'all' ELSE concat(lower(p_type), '/', p_brand, '-x') END AS source,
  CASE WHEN p_size % 3 = 0 THEN 'all' ELSE 'code' END AS domain, CAST(p_size * 128 AS BIGINT) AS max_tokens,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size * 16 AS BIGINT) END AS max_assistant,
  CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'easy_to_hard' WHEN 2 THEN 'first_epoch_only' ELSE 'grouped_shuffle' END AS mode
  FROM part), named AS (SELECT *, concat('corpus_', CASE WHEN domain = 'all' THEN 'all_domains' ELSE domain END, '_',
  CASE WHEN source = 'all' THEN 'all_sources' ELSE replace(replace(source, '/', '_'), '-', '_') END, '_t', max_tokens,
  CASE WHEN max_assistant IS NULL THEN '' ELSE concat('_at', max_assistant) END, '_n', id) AS subset_name FROM parts),
  runs AS (SELECT *, concat(subset_name, '_s0.9_bs', id % 64, '_lr1e-05_e', id % 7, '_r', id % 128,
  CASE WHEN mode = 'none' THEN '' ELSE concat('_c', mode) END, '_Org_Net-', id, 'B-Instruct') AS run_name FROM named)"""


def _named(spark, sf_dir):
    size = F.col("p_size")
    mode = (
        F.when(size % 4 == 0, "none").when(size % 4 == 1, "easy_to_hard").when(size % 4 == 2, "first_epoch_only")
    ).otherwise("grouped_shuffle")
    source = F.concat(F.lower("p_type"), F.lit("/"), "p_brand", F.lit("-x"))
    parts = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(size % 5 == 0, "all").otherwise(source).alias("source"),
        F.when(size % 3 == 0, "all").otherwise("code").alias("domain"),
        (size * 128).cast("long").alias("max_tokens"),
        F.when(size % 4 != 0, (size * 16).cast("long")).alias("max_assistant"),
        mode.alias("mode"),
    )
    name = names.subset_name(*[F.col(c) for c in ("source", "domain", "max_tokens", "max_assistant", "id")])
    return parts.withColumn("subset_name", name)


def _run_names(spark, sf_dir):
    key = F.col("id")
    model = F.concat(F.lit("Org/Net-"), key.cast("string"), F.lit("B-Instruct"))
    name = names.run_name(
        F.col("subset_name"), F.lit("0.9"), key % 64, F.lit("1e-05"), key % 7, key % 128, F.col("mode"), model
    )
    return _named(spark, sf_dir).withColumn("run_name", name)


@query(f"WITH {_NAME_PARTS} SELECT id, subset_name FROM named")
def subset_name(spark, sf_dir):
    return _named(spark, sf_dir).select("id", "subset_name")


@query(f"WITH {_NAME_PARTS} SELECT id, run_name FROM runs")
def run_name(spark, sf_dir):
    return _run_names(spark, sf_dir).select("id", "run_name")


@query(
    f"WITH {_NAME_PARTS} SELECT id, subset_name AS dataset, 0.9E0 AS train_split, id % 64 AS batch_size,"
    " 1e-5 AS learning_rate, id % 7 AS epochs, id % 128 AS rank, mode AS curriculum,"
    " concat('Org/Net-', id, 'B-Instruct') AS model, max_tokens FROM runs"
)
def parse_run_config(spark, sf_dir):
    parsed = _run_names(spark, sf_dir).withColumn("c", names.run_config(F.col("run_name"))).select("id", "c.*")
    return parsed.withColumn("max_tokens", names.max_tokens_of(F.col("dataset")))


_PATHS = """paths AS (SELECT p_partkey AS id, concat('file:/logs/config_', p_size, '/2025', lpad(CAST(p_partkey AS VARCHAR), 8, '0'),
  '/', lower(p_type), '/', CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 7 = 0 THEN 'step_x/'
  ELSE concat('step_', lpad(CAST(p_partkey AS VARCHAR), 6, '0'), '/') END, 'results.jsonl') AS path FROM part)"""


@query(
    f"WITH {_PATHS}, k AS (SELECT id, regexp_extract(path, '/logs/([^/]+)/', 1) AS config,"
    " regexp_extract(path, '/logs/[^/]+/([^/]+)/', 1) AS run, regexp_extract(path, '/logs/[^/]+/[^/]+/([^/]+)/', 1) AS eval,"
    " regexp_extract(path, '/step_([^/]+)/', 1) AS s FROM paths) SELECT id, config, run, eval,"
    " CASE WHEN s = '' THEN -1 ELSE TRY_CAST(s AS BIGINT) END AS step FROM k WHERE s = '' OR TRY_CAST(s AS BIGINT) IS NOT NULL"
)
def run_keys(spark, sf_dir):
    from reasonset.sources.results import with_run_keys

    key = F.col("p_partkey").cast("string")
    step = F.concat(F.lit("step_"), F.lpad(key, 6, "0"), F.lit("/"))
    folder = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 7 == 0, "step_x/").otherwise(step)
    path = F.concat(
        F.lit("file:/logs/config_"), F.col("p_size").cast("string"), F.lit("/2025"), F.lpad(key, 8, "0"), F.lit("/"),
        F.lower("p_type"), F.lit("/"), folder, F.lit("results.jsonl"),
    )
    paths = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), path.alias("path"))
    return with_run_keys(paths).drop("path")


@query(
    f"WITH {_NAME_PARTS}, p AS (SELECT id, concat('logs/', subset_name, '_Org_Net-', id, CASE id % 3 WHEN 0 THEN '-Instruct'"
    " WHEN 1 THEN '-Base' ELSE '' END, '/comparisons/summary.txt') AS path FROM named)"
    " SELECT id, concat('Org/Net-', id, CASE id % 3 WHEN 0 THEN '-Instruct' WHEN 1 THEN '-Base' ELSE '' END) AS model_name,"
    " CASE id % 3 WHEN 0 THEN 'Instruct' WHEN 1 THEN 'Base' ELSE 'Full' END AS model_type FROM p"
)
def model_type(spark, sf_dir):
    key = F.col("id")
    kind = F.when(key % 3 == 0, "-Instruct").when(key % 3 == 1, "-Base").otherwise("")
    path = F.concat(
        F.lit("logs/"), "subset_name", F.lit("_Org_Net-"), key.cast("string"), kind, F.lit("/comparisons/summary.txt")
    )
    named = _named(spark, sf_dir).select("id", names.model_name(path).alias("model_name"))
    return named.withColumn("model_type", names.model_type(F.col("model_name")))


@query(
    "SELECT p_partkey AS id, concat(repeat('█', CAST(floor(p_size / 100.0E0 * 50) AS BIGINT)),"
    " repeat('░', 50 - CAST(floor(p_size / 100.0E0 * 50) AS BIGINT))) AS bar FROM part"
)
def bar(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), text.bar(F.col("p_size").cast("double")).alias("bar"))


# ---------------------------------------------------------------- prompts

_WORD = (
    "'user: How many r''s are in strawberry?', chr(10), 'assistant: Let''s spell the word out and number all the letters:"
    " 1) s 2) t 3) r 4) a 5) w 6) b 7) e 8) r 9) r 10) y. We have r''s at positions 3, 8, and 9. ', chr(92), 'boxed{3}',"
    " chr(10), 'user: ', text, ' Provide a numerical answer without units, written inside ', chr(92), 'boxed{}.'"
)


@query(
    "SELECT doc_id AS id, concat('Problem: ', text, chr(10), 'Mark your solution with ', chr(92), 'boxed', chr(10), 'Answer:')"
    " AS math_prompt, concat('Generate an executable Python function generated from the given prompt. ', CASE WHEN doc_id % 2 = 0"
    " THEN 'The function should take stdin as input and print the output. Simply call the function after the definition.'"
    " ELSE 'Return the function body without invoking it at the final solution.' END, chr(10), text) AS code_prompt,"
    f" concat({_WORD}) AS word_prompt FROM documents"
)
def build_prompts(spark, sf_dir):
    said = F.transform(
        prompts.word_prompt(F.col("text")), lambda m: F.concat(m["role"], F.lit(": "), m["text"])
    )
    return views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        prompts.math_prompt(F.col("text")).alias("math_prompt"),
        prompts.code_prompt(F.col("text"), F.col("doc_id") % 2 == 0).alias("code_prompt"),
        F.array_join(said, "\n").alias("word_prompt"),
    )


# The options of each question in hash order, and the prompt that shows them.
_SHUFFLED = f"""WITH {CHOICES}, o AS (
  SELECT id, question, correct, 0 AS i, correct AS option FROM choices UNION ALL
  SELECT id, question, correct, 1, wrong1 FROM choices UNION ALL
  SELECT id, question, correct, 2, wrong2 FROM choices UNION ALL
  SELECT id, question, correct, 3, wrong3 FROM choices), r AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(concat('42:', question, ':', i)), option) AS pos FROM o),
 shown AS (SELECT id, question, string_agg(concat(substr('ABCD', CAST(pos AS INT), 1), ') ', option), chr(10) ORDER BY pos) AS options,
  substr('ABCD', CAST(min(pos) FILTER (option = correct) AS INT), 1) AS answer FROM r GROUP BY id, question)"""


def _shuffled(spark, sf_dir):
    rows = views.choices(spark, sf_dir)
    return rows.withColumn("options", prompts.shuffle_options(F.col("question"), F.col("options")))


@query(
    f"{_SHUFFLED} SELECT id, concat('Problem: ', question, chr(10), chr(10), 'Options:', chr(10), options, chr(10), chr(10),"
    " 'Return your final response within ', chr(92), 'boxed{} and only include the letter choice (A, B, C, or D) as your"
    " final response.') AS prompt, answer FROM shown"
)
def shuffle_options(spark, sf_dir):
    return _shuffled(spark, sf_dir).select(
        "id",
        prompts.choice_prompt(F.col("question"), F.col("options")).alias("prompt"),
        prompts.answer_letter(F.col("options"), F.col("correct")).alias("answer"),
    )


@query(
    f"WITH {CHOICES} SELECT id, CASE WHEN id % 5 = 0 THEN concat(' ', question, ' ') ELSE concat('Problem: ', question) END"
    " AS question_key FROM choices"
)
def question_key(spark, sf_dir):
    prompt = prompts.choice_prompt(F.col("question"), F.col("options"))
    bare = F.concat(F.lit(" "), "question", F.lit(" "))
    stored = F.when(F.col("id") % 5 == 0, bare).otherwise(prompt)
    return _shuffled(spark, sf_dir).select("id", text.question_key(stored).alias("question_key"))


# ---------------------------------------------------------------- answers

_ANSWER = "coalesce(" + ", ".join(
    f"{stripped(f'''list_extract(regexp_extract_all(content, {pattern}, 1), -1)''')}"
    for pattern in (
        r"'\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}'",
        r"'\\boxed\{([^}]+)\}'",
        r"'(?i)ANSWER:\s*([^\n]+)'",
    )
) + ", '')"


@query(f"WITH {views.ANSWERS} SELECT event_id, {_ANSWER} AS model_answer FROM answers")
def extract_answer(spark, sf_dir):
    return views.answers(spark, sf_dir).select("event_id", answers.extract_answer(F.col("content")).alias("model_answer"))


def _normal(column):
    plain = stripped(f"replace(replace({column}, '$', ''), ',', '')")
    return f"coalesce(nullif(regexp_extract({plain}, '[-+]?\\d+'), ''), {plain})"


_GRADED = f"""WITH {views.ANSWERS}, extracted AS (SELECT event_id, k, content, target, {_ANSWER} AS model_answer FROM
  (SELECT a.*, regexp_extract(e.props, '([0-9]+)', 1) AS k FROM answers a JOIN events e USING (event_id)) x),
 normal AS (SELECT *, {_normal('model_answer')} AS na, {_normal('target')} AS nt FROM extracted),
 graded AS (SELECT *, coalesce(na = nt OR TRY_CAST(na AS HUGEINT) = TRY_CAST(nt AS HUGEINT), false) AS is_correct FROM normal)"""


@query(f"{_GRADED} SELECT event_id, model_answer, is_correct FROM graded")
def grade_answer(spark, sf_dir):
    from reasonset.operators.scoring import grade

    return grade(views.answers(spark, sf_dir)).select("event_id", "model_answer", "is_correct")


@query(f"WITH {views.ANSWERS} SELECT event_id, regexp_extract(content, '\\\\boxed\\{{([A-D])\\}}', 1) AS letter FROM answers")
def extract_letter(spark, sf_dir):
    return views.answers(spark, sf_dir).select("event_id", answers.extract_letter(F.col("content")).alias("letter"))


@query(
    f"WITH {views.ANSWERS}, b AS (SELECT event_id, content, regexp_extract(content, '.*\\\\boxed\\{{([^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*)\\}}', 1) AS box,"
    " regexp_extract(props, '([0-9]+)', 1) AS truth FROM answers JOIN events USING (event_id)),"
    f" n AS (SELECT *, {_normal('box')} AS nb FROM b) SELECT event_id, CASE WHEN strpos(content, 'boxed') = 0 THEN 0.0E0"
    " WHEN nb = truth OR coalesce(TRY_CAST(nb AS HUGEINT) = TRY_CAST(truth AS HUGEINT), false) THEN 1.0E0 ELSE 0.0E0 END"
    " AS reward FROM n"
)
def reward(spark, sf_dir):
    solution = F.concat(F.lit("some work\n#### "), "k")
    return views.answers(spark, sf_dir).select("event_id", answers.reward(F.col("content"), solution).alias("reward"))


# Documents as model texts: one fence, two fences, none, and one with other marks in it.
_RESPONSES = """responses AS (SELECT doc_id AS id, CASE doc_id % 4
  WHEN 0 THEN concat('try this:', chr(10), '```python', chr(10), text, chr(10), '```', chr(10), 'done')
  WHEN 1 THEN concat('```', chr(10), 'x = 1', chr(10), '``` better: ```py', chr(10), text, '``` end')
  WHEN 2 THEN text
  ELSE concat('```python', chr(10), '<code>', text, '</code> trailing', chr(10), '```') END AS content, text FROM documents)"""


@query(
    f"WITH {_RESPONSES}, c AS (SELECT id, list_extract(regexp_extract_all(content, '(?s)```(?:[a-zA-Z]*)\\n(.*?)```', 1), -1)"
    " AS code FROM responses) SELECT id, CASE WHEN code <> '' THEN replace(split_part(replace(split_part(code, '</code>', 1),"
    " '```python', ''), '```', 1), '<code>', '') END AS code, CASE WHEN coalesce(code, '') = '' THEN 'No code found' ELSE ''"
    " END AS error FROM c"
)
def extract_code(spark, sf_dir):
    body = F.col("text")
    style = F.col("doc_id") % 4
    content = (
        F.when(style == 0, F.concat(F.lit("try this:\n```python\n"), body, F.lit("\n```\ndone")))
        .when(style == 1, F.concat(F.lit("```\nx = 1\n``` better: ```py\n"), body, F.lit("``` end")))
        .when(style == 2, body)
        .otherwise(F.concat(F.lit("```python\n<code>"), body, F.lit("</code> trailing\n```")))
    )
    found = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), answers.extract_code(content).alias("code")
    )
    return found.withColumn("error", F.when(F.col("code").isNull(), fixed.NO_CODE).otherwise(""))


_EXPECTED = "concat(' ', o_orderpriority, CASE o_orderkey % 4 WHEN 0 THEN '-' WHEN 1 THEN concat(' - ', chr(10)) ELSE chr(10) END)"
_CUT = stripped(_EXPECTED)


@query(
    f"SELECT o_orderkey AS id, CASE WHEN ends_with({_CUT}, '-') THEN rtrim(left({_CUT}, length({_CUT}) - 1), {BLANKS})"
    f" ELSE {_CUT} END AS expected, CASE o_orderkey % 3 WHEN 0 THEN false ELSE true END AS passed FROM orders"
)
def grade_output(spark, sf_dir):
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    tail = F.when(key % 4 == 0, "-").when(key % 4 == 1, " - \n").otherwise("\n")
    expected = F.concat(F.lit(" "), priority, tail)
    actual = F.when(key % 3 == 0, F.concat(priority, F.lit("?"))).otherwise(F.concat(priority, F.lit("\n\n")))
    return views.table(spark, sf_dir, "orders").select(
        key.alias("id"),
        answers.expected_output(expected).alias("expected"),
        answers.same_output(actual, expected).alias("passed"),
    )


# ---------------------------------------------------------------- token arrays

@query(
    "WITH v AS (SELECT vec_id, label, len(embedding) AS n, unnest(range(1, len(embedding))) AS pos, embedding FROM embeddings)"
    " SELECT vec_id AS id, pos - 1 AS pos, CAST(floor(CAST(embedding[pos] AS DOUBLE) * 1000) AS BIGINT) AS input,"
    " CAST(floor(CAST(embedding[pos + 1] AS DOUBLE) * 1000) AS BIGINT) AS target,"
    " CASE WHEN pos <= label % 7 THEN 0.0E0 ELSE round(CAST(embedding[pos + 1] AS DOUBLE), 6) END AS logprob,"
    " CASE WHEN pos <= label % 7 THEN 0.0E0 ELSE CAST(label AS DOUBLE) END AS advantage, true AS lengths_ok FROM v"
)
def to_training_arrays(spark, sf_dir):
    # The first label % 7 + 1 tokens are the prompt, the rest was sampled with these logprobs.
    tokens = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000))
    prompt = F.col("label") % 7 + 1
    sampled = F.slice("embedding", prompt + 1, F.size("embedding") - prompt)
    made = arrays.training_arrays(tokens, prompt, sampled, F.col("label"))
    rows = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), made.alias("a"))
    zipped = F.arrays_zip("a.inputs", "a.targets", "a.logprobs", "a.advantages")
    long = rows.select("id", "a.lengths_ok", F.posexplode(zipped).alias("pos", "z"))
    return long.select(
        "id", F.col("pos").cast("long").alias("pos"), F.col("z.inputs").alias("input"), F.col("z.targets").alias("target"),
        F.round("z.logprobs", 6).alias("logprob"), F.col("z.advantages").alias("advantage"), "lengths_ok",
    )
