"""Scans, filters, statistics, browsing and subsets."""

from pyspark.sql import functions as F

from reasonset.operators import corpus, predicates, stats
from reasonset.operators import turns as turn_ops
from reasonset.sources.corpus import read_corpus

from . import views
from .registry import query
from .views import CONV_EXAMPLES, EXAMPLES


@query("SELECT doc_id AS id, source, lang AS domain, n_chars, text FROM documents")
def scan_corpus(spark, sf_dir):
    df = read_corpus(spark, f"{sf_dir}/documents.parquet")
    return df.select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("domain"), "n_chars", "text")


def _filtered(**filters):
    def run(spark, sf_dir):
        rows = views.examples(spark, sf_dir).filter(predicates.corpus_filter(**filters))
        return rows.select("id", "source", "domain", "difficulty")

    return run


_COLUMNS = f"WITH {EXAMPLES} SELECT id, source, domain, difficulty FROM examples"
query(f"{_COLUMNS} WHERE difficulty IS NULL", "filter_null_difficulty")(
    _filtered(difficulty_min="null", difficulty_max=8)
)
query(f"{_COLUMNS} WHERE difficulty >= 0 AND difficulty <= 0", "filter_range")(
    _filtered(difficulty_min=0, difficulty_max=0, source="all")
)
query(f"{_COLUMNS} WHERE source = 'src7' AND domain = 'en'", "filter_source_domain")(
    _filtered(source="src7", domain="en", difficulty_max=1)
)


@query(f"WITH {EXAMPLES} SELECT count(*) AS n FROM examples WHERE difficulty >= 1 AND domain = 'en'")
def count_matching(spark, sf_dir):
    wanted = predicates.corpus_filter(difficulty_min=1, domain="en")
    return stats.count_matching(views.examples(spark, sf_dir), wanted)


@query(
    "SELECT o_orderkey, o_orderdate FROM orders"
    " WHERE o_orderdate >= TIMESTAMP '1998-08-01' AND o_orderdate < TIMESTAMP '1999-02-01'"
)
def date_window(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return predicates.date_window(orders, "o_orderdate", "1998-08-01", "1999-02-01")


@query(
    "SELECT DISTINCT source FROM (SELECT n_name AS source FROM nation UNION ALL SELECT source FROM documents"
    " UNION ALL SELECT 'all') w WHERE source <> 'all' AND source NOT IN (SELECT source FROM documents)"
)
def unknown_values(spark, sf_dir):
    known = views.table(spark, sf_dir, "documents").select("source").distinct()
    nations = views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"))
    requested = nations.union(known).union(spark.range(1).select(F.lit("all")))
    return predicates.unknown_values(requested, known, "source")


@query(
    f"WITH {EXAMPLES}, missing AS (SELECT id FROM examples WHERE difficulty IS NULL)"
    " SELECT id, (SELECT count(*) FROM missing) AS n_missing FROM missing ORDER BY id LIMIT 5"
)
def check_difficulty(spark, sf_dir):
    return predicates.check_difficulty(views.examples(spark, sf_dir))


@query("SELECT p_partkey AS id, (p_size % 3 = 0 OR p_size % 5 = 0) AS is_stdin FROM part")
def has_test_type(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    first = F.when(F.col("p_size") % 3 == 0, "stdin").otherwise("functional")
    second = F.when(F.col("p_size") % 5 == 0, ', "testtype": "stdin"').otherwise("")
    tests = F.concat(
        F.lit('[{"input": "'), "p_name", F.lit('", "testtype": "'), first,
        F.lit('"}, {"input": "'), "p_name", F.lit('"'), second, F.lit("}]"),
    )
    return part.select(F.col("p_partkey").alias("id"), predicates.has_test_type(tests, "stdin").alias("is_stdin"))


_SPLIT = "CASE p_size % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'test' ELSE 'extra' END"


@query(
    f"WITH s AS (SELECT p_partkey // 7 AS subset, {_SPLIT} AS split, p_partkey AS split_no FROM part),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY CASE split WHEN 'train' THEN 0"
    " WHEN 'validation' THEN 1 ELSE 2 END, split_no) AS rn FROM s)"
    " SELECT subset, split AS picked_split, 'train' AS split FROM r WHERE rn = 1"
)
def pick_split(spark, sf_dir):
    kind = F.col("p_size") % 4
    split = F.when(kind == 0, "train").when(kind == 1, "validation").when(kind == 2, "test").otherwise("extra")
    splits = views.table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 7).alias("subset"), split.alias("split"), F.col("p_partkey").alias("split_no")
    )
    return predicates.pick_train_split(splits, ["subset"])


# ---------------------------------------------------------------- statistics

_BASIC = """count(*) AS total_rows, count(DISTINCT source) AS unique_sources, count(DISTINCT domain) AS unique_domains,
 round(CAST(avg(difficulty) AS DOUBLE), 6) AS avg_difficulty, min(difficulty) AS min_difficulty,
 max(difficulty) AS max_difficulty"""


@query(f"WITH {EXAMPLES} SELECT {_BASIC} FROM examples")
def basic_stats(spark, sf_dir):
    found = stats.basic_stats(views.examples(spark, sf_dir))
    return found.withColumn("avg_difficulty", F.round("avg_difficulty", 6))


def _distribution(column):
    def run(spark, sf_dir):
        return stats.distribution(views.examples(spark, sf_dir), column)

    order = "difficulty NULLS LAST" if column == "difficulty" else f"n DESC, {column}"
    sql = f"WITH {EXAMPLES} SELECT {column}, count(*) AS n FROM examples GROUP BY {column} ORDER BY {order}"
    query(sql, f"dist_{column}")(run)


for _column in ("difficulty", "source", "domain"):
    _distribution(_column)


# One row per (source or all, domain or all), with the examples each choice matches.
_CHOICES = f"""WITH {CONV_EXAMPLES},
 s AS (SELECT 'all' AS source UNION SELECT source FROM conv_examples WHERE source <> ''),
 d AS (SELECT 'all' AS domain UNION SELECT domain FROM conv_examples WHERE domain <> ''),
 pairs AS (SELECT source, domain FROM s, d),
 matched AS (SELECT p.source AS wanted_source, p.domain AS wanted_domain, e.* FROM pairs p JOIN conv_examples e
   ON (p.source = 'all' OR p.source = e.source) AND (p.domain = 'all' OR p.domain = e.domain))"""


@query(
    f"{_CHOICES}, found AS (SELECT wanted_source, wanted_domain, {_BASIC} FROM matched GROUP BY 1, 2)"
    " SELECT p.source, p.domain, coalesce(total_rows, 0) AS total_rows, coalesce(unique_sources, 0) AS unique_sources,"
    " coalesce(unique_domains, 0) AS unique_domains, avg_difficulty, min_difficulty, max_difficulty"
    " FROM pairs p LEFT JOIN found f ON p.source = f.wanted_source AND p.domain = f.wanted_domain"
)
def stats_cube(spark, sf_dir):
    found = stats.stats_cube(views.conv_examples(spark, sf_dir))
    return found.withColumn("avg_difficulty", F.round("avg_difficulty", 6))


@query(
    f"{_CHOICES} SELECT wanted_source AS source, wanted_domain AS domain, 'difficulty' AS dimension,"
    " coalesce(CAST(difficulty AS VARCHAR), 'None') AS key, count(*) AS n FROM matched GROUP BY ALL"
    " UNION ALL SELECT wanted_source, wanted_domain, 'source', coalesce(source, 'null'), count(*) FROM matched GROUP BY ALL"
    " UNION ALL SELECT wanted_source, wanted_domain, 'domain', coalesce(domain, 'null'), count(*) FROM matched GROUP BY ALL"
)
def stats_cube_dist(spark, sf_dir):
    return stats.stats_cube_dist(views.conv_examples(spark, sf_dir))


@query(
    f"{_CHOICES} SELECT 'src1' AS source, 'all' AS domain, {_BASIC} FROM matched"
    " WHERE wanted_source = 'src1' AND wanted_domain = 'all'"
)
def lookup_stats(spark, sf_dir):
    found = stats.lookup_stats(stats.stats_cube(views.conv_examples(spark, sf_dir)), "src1", "all")
    return found.withColumn("avg_difficulty", F.round("avg_difficulty", 6))


@query(
    f"WITH {EXAMPLES} SELECT (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT source AS s FROM examples"
    " WHERE source <> '') a) AS sources, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT domain AS s"
    " FROM examples WHERE domain <> '') b) AS domains, min(difficulty) AS difficulty_min,"
    " max(difficulty) AS difficulty_max FROM examples"
)
def filter_options(spark, sf_dir):
    options = stats.filter_options(views.examples(spark, sf_dir))
    return options.withColumns({c: F.array_join(c, ",") for c in ("sources", "domains")})


# ---------------------------------------------------------------- browsing and subsets

_TOKENS = """tokens AS (
  SELECT conv_id AS id, CAST(sum(length(text) // 4) AS BIGINT) AS total_tokens,
         CAST(coalesce(arg_min(length(text) // 4, turn) FILTER (role = 'assistant'), 0) AS BIGINT) AS assistant_tokens,
         CAST(sum(length(text)) // 4 AS BIGINT) AS browse_tokens,
         coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS user_text,
         coalesce(arg_min(text, turn) FILTER (role = 'assistant'), '') AS assistant_text,
         count(*) AS n_messages, string_agg(text, chr(10) ORDER BY turn) AS body
  FROM conversations GROUP BY conv_id)"""

_PREVIEW = """CASE WHEN NOT asked THEN 'No user message found'
  WHEN length(user_text) > 500 THEN concat(substr(user_text, 1, 500), '...') ELSE user_text END"""


def _plain(df):
    """Token columns under names without a leading underscore."""
    return df.withColumnsRenamed({"_total_tokens": "total_tokens", "_assistant_tokens": "assistant_tokens"})


@query(f"WITH {_TOKENS} SELECT id, total_tokens, assistant_tokens FROM tokens")
def with_tokens(spark, sf_dir):
    return _plain(turn_ops.with_tokens(views.turns(spark, sf_dir)))


@query(f"WITH {_TOKENS} SELECT id, browse_tokens AS tokens FROM tokens")
def with_browse_tokens(spark, sf_dir):
    return turn_ops.with_browse_tokens(views.turns(spark, sf_dir))


@query(f"WITH {_TOKENS} SELECT id, user_text, assistant_text FROM tokens")
def first_turn(spark, sf_dir):
    return turn_ops.first_turns(views.turns(spark, sf_dir))


@query(
    f"WITH {_TOKENS} SELECT id, total_tokens, assistant_tokens FROM tokens"
    " WHERE total_tokens <= 700 AND assistant_tokens <= 200"
)
def token_budget(spark, sf_dir):
    return _plain(predicates.token_budget(turn_ops.with_tokens(views.turns(spark, sf_dir)), 700, 200))


@query(
    f"WITH {_TOKENS}, seen AS (SELECT t.*, EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = t.id"
    f" AND c.role = 'user') AS asked FROM tokens t) SELECT id, {_PREVIEW} AS preview FROM seen"
)
def preview(spark, sf_dir):
    return turn_ops.previews(views.turns(spark, sf_dir))


@query(
    f"WITH {_TOKENS}, {CONV_EXAMPLES}, seen AS (SELECT t.*, EXISTS (SELECT 1 FROM conversations c"
    " WHERE c.conv_id = t.id AND c.role = 'user') AS asked FROM tokens t)"
    f" SELECT id, difficulty, source, domain, browse_tokens AS tokens, {_PREVIEW} AS preview"
    " FROM conv_examples JOIN seen USING (id)"
)
def browse_table(spark, sf_dir):
    return turn_ops.browse_table(views.conv_examples(spark, sf_dir), views.turns(spark, sf_dir))


@query(
    f"WITH {EXAMPLES} SELECT id, source, difficulty FROM examples WHERE domain = 'en' ORDER BY id LIMIT 50 OFFSET 100"
)
def page(spark, sf_dir):
    rows = views.examples(spark, sf_dir).filter(predicates.corpus_filter(domain="en"))
    return corpus.page(rows.select("id", "source", "difficulty"), 3)


@query(
    f"WITH {EXAMPLES} SELECT id, source, difficulty FROM examples WHERE domain = 'en' AND id > 500 ORDER BY id LIMIT 50"
)
def page_after(spark, sf_dir):
    rows = views.examples(spark, sf_dir).filter(predicates.corpus_filter(domain="en"))
    return corpus.page(rows.select("id", "source", "difficulty"), 3, after=500)


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 200 OFFSET 12000"
)
def page_deep(spark, sf_dir):
    # A page beyond row 10,000 of a table whose order takes two columns.
    rows = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return corpus.page(rows, 61, 200, key=["l_orderkey", "l_linenumber"])


@query(
    f"WITH {_TOKENS}, {CONV_EXAMPLES} SELECT id, source, domain, difficulty, total_tokens, assistant_tokens, n_messages,"
    " body FROM conv_examples JOIN tokens USING (id) WHERE total_tokens <= 700 AND assistant_tokens <= 400"
    " ORDER BY id LIMIT 30"
)
def make_subset(spark, sf_dir):
    subset = corpus.make_subset_of_turns(
        views.conv_examples(spark, sf_dir), views.turns(spark, sf_dir), 700, 30, max_assistant_tokens=400
    )
    return _plain(subset).select(
        "id", "source", "domain", "difficulty", "total_tokens", "assistant_tokens",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: m["text"]), "\n").alias("body"),
    )


@query(
    f"WITH {EXAMPLES} SELECT id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id) AS rn"
    " FROM examples) r WHERE rn <= 20"
)
def subset_per_source(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    return corpus.subset_per_source(rows, 20)


_REQUESTS = [
    {"source": "all", "max_tokens": 500, "limit": 100},
    {"source": "all", "max_tokens": 4096, "limit": 100_000},
    {"source": "src7", "max_tokens": 1000, "limit": 15},
    {"source": "src3", "max_tokens": 300, "limit": 1000},
    {"source": "missing", "max_tokens": 1000, "limit": 10},
]
_REQUEST_ROWS = ", ".join(
    f"({i}, '{r['source']}', CAST({r['max_tokens']} AS BIGINT), CAST({r['limit']} AS BIGINT))"
    for i, r in enumerate(_REQUESTS)
)


@query(
    f"WITH requests(request, wanted_source, max_tokens, lim) AS (VALUES {_REQUEST_ROWS}), ranked AS ("
    "SELECT q.*, d.doc_id AS id, d.source, row_number() OVER (PARTITION BY request ORDER BY doc_id) AS rn"
    " FROM requests q JOIN documents d ON length(d.text) // 4 <= q.max_tokens"
    " AND (q.wanted_source = 'all' OR q.wanted_source = d.source))"
    ' SELECT request, wanted_source, max_tokens, lim AS "limit", id, source FROM ranked WHERE rn <= lim'
)
def subset_sweep(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "source", F.floor(F.length("text") / 4).alias("_total_tokens")
    )
    return corpus.subset_sweep(rows, _REQUESTS).drop("_total_tokens")


# Thousands of requests from a table: a part asks for as many documents as its size, of one source or of all.
@query(
    "WITH requests AS (SELECT p_partkey AS request, CASE WHEN p_size % 5 = 0 THEN 'all' ELSE concat('src', p_partkey % 14) END AS wanted_source,"
    " p_partkey * 7 % 3000 AS max_tokens, p_size AS lim FROM part), ranked AS ("
    "SELECT q.*, d.doc_id AS id, d.source, row_number() OVER (PARTITION BY request ORDER BY doc_id) AS rn"
    " FROM requests q JOIN documents d ON length(d.text) // 4 <= q.max_tokens AND (q.wanted_source = 'all' OR q.wanted_source = d.source))"
    ' SELECT request, wanted_source, max_tokens, lim AS "limit", id, source FROM ranked WHERE rn <= lim'
)
def subset_sweep_of(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    source = F.concat(F.lit("src"), (F.col("p_partkey") % 14).cast("string"))
    requests = part.select(
        F.col("p_partkey").alias("request"), F.when(F.col("p_size") % 5 == 0, "all").otherwise(source).alias("wanted_source"),
        (F.col("p_partkey") * 7 % 3000).alias("max_tokens"), F.col("p_size").alias("limit"),
    )
    rows = views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "source", F.floor(F.length("text") / 4).alias("_total_tokens")
    )
    return corpus.subset_sweep_of(rows, requests).drop("_total_tokens")


@query(
    f"WITH {_TOKENS} SELECT count(*) AS total_rows, round(coalesce(avg(total_tokens), 0), 6) AS avg_total_tokens,"
    " round(coalesce(avg(assistant_tokens), 0), 6) AS avg_assistant_tokens FROM tokens WHERE total_tokens <= 700"
)
def subset_stats(spark, sf_dir):
    kept = predicates.token_budget(turn_ops.with_tokens(views.turns(spark, sf_dir)), 700)
    found = corpus.subset_stats(kept)
    return found.withColumns({c: F.round(c, 6) for c in ("avg_total_tokens", "avg_assistant_tokens")})


@query(
    f"WITH {_TOKENS}, k AS (SELECT count(*) AS scanned, count(*) FILTER (total_tokens <= 500 AND assistant_tokens <= 200)"
    " AS kept FROM tokens) SELECT scanned, kept, scanned - kept AS rejected, CASE WHEN scanned = 0 THEN 0.0"
    " ELSE round(kept * 100.0E0 / scanned, 6) END AS pass_rate, greatest(5000 - kept, 0) AS shortfall FROM k"
)
def scan_funnel(spark, sf_dir):
    found = corpus.scan_funnel(turn_ops.with_tokens(views.turns(spark, sf_dir)), 500, 5000, 200)
    return found.withColumn("pass_rate", F.round("pass_rate", 6))


_SPLIT_ASSISTANT = "strpos(assistant_text, '<think>') > 0 AND strpos(assistant_text, '</think>') > 0"


@query(
    f"WITH {views.MARKED_TURNS}, {CONV_EXAMPLES}, texts AS (SELECT id,"
    " coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS user_text,"
    " coalesce(arg_min(text, turn) FILTER (role = 'assistant'), '') AS assistant_text FROM marked_turns GROUP BY id),"
    " first_ten AS (SELECT *, row_number() OVER (ORDER BY id) AS sample FROM conv_examples JOIN texts USING (id)"
    " ORDER BY id LIMIT 10), parts AS (SELECT *,"
    f" CASE WHEN {_SPLIT_ASSISTANT} THEN "
    + views.stripped("regexp_extract(assistant_text, '(?s)<think>(.*?)</think>', 1)")
    + f" ELSE '' END AS reasoning, CASE WHEN {_SPLIT_ASSISTANT} THEN "
    + views.stripped("regexp_extract(assistant_text, '(?s)<think>.*?</think>(.*)$', 1)")
    + " ELSE " + views.stripped("assistant_text") + " END AS output FROM first_ten)"
    " SELECT sample, concat('# Sample ', sample, chr(10), chr(10), '**Source:** ', source, '  ', chr(10),"
    " '**Domain:** ', domain, '  ', chr(10), '**Difficulty:** ', coalesce(CAST(difficulty AS VARCHAR), 'N/A'),"
    " chr(10), chr(10), '---', chr(10), chr(10), '## User Input', chr(10), chr(10), user_text,"
    " chr(10), chr(10), '---', chr(10), chr(10), '## Thinking Tokens', chr(10), chr(10),"
    " CASE WHEN reasoning = '' THEN '*No thinking tokens found*' ELSE reasoning END,"
    " chr(10), chr(10), '---', chr(10), chr(10), '## Output', chr(10), chr(10), output, chr(10)) AS document FROM parts"
)
def sample_documents(spark, sf_dir):
    return corpus.sample_documents_of_turns(views.conv_examples(spark, sf_dir), views.marked_turns(spark, sf_dir))
