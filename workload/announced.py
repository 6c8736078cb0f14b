"""Answers side by side, responses to one input, and mixtures of sources."""

from pyspark.sql import functions as F

from reasonset.functions import diff
from reasonset.operators import answers, mixtures

from . import views
from .registry import query

# Answers of a base model, and what a tuned one made of them: words left out, lines broken, a passage put in, or nothing changed.
_TUNED = r"""CASE conv_id % 4 WHEN 0 THEN regexp_replace(text, ' t[a-z]*', '', 'g') WHEN 1 THEN concat('So ', replace(text, '. ', '.' || chr(10)))
 WHEN 2 THEN concat(substr(text, 1, 40), ' put in' || chr(10) || 'here ', substr(text, 90)) ELSE text END"""


def _subsequence(name: str, source: str) -> str:
    """Two recursive tables: the lengths of common subsequences row by row, and the walk back over them."""
    return f"""{name}_rows AS (
  SELECT id, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0::BIGINT) AS l FROM {source}
  UNION ALL
  SELECT id, i + 1, list_transform(c, lambda x, k: list_max(c[:k])) FROM (
    SELECT r.id, r.i, list_transform(range(len(s.b) + 1), lambda j: CASE WHEN j > 0 AND s.a[r.i + 1] = s.b[j] THEN r.l[j] + 1 ELSE r.l[j + 1] END) AS c
    FROM {name}_rows r JOIN {source} s USING (id) WHERE r.i < len(s.a)) n
), {name}_back AS (
  SELECT id, len(a) AS i, len(b) AS j, NULL::BIGINT AS m, NULL::BIGINT AS p FROM {source}
  UNION ALL
  SELECT id, i - 1, CASE WHEN hit THEN q - 1 ELSE j END, CASE WHEN hit THEN i END, CASE WHEN hit THEN q END FROM (
    SELECT w.id, w.i, w.j, x.l[w.j + 1] <> y.l[w.j + 1] AS hit, list_position(x.l, x.l[w.j + 1]) - 1 AS q
    FROM {name}_back w JOIN {name}_rows x ON x.id = w.id AND x.i = w.i JOIN {name}_rows y ON y.id = w.id AND y.i = w.i - 1 WHERE w.i > 0) n
), {name}_ends AS (
  SELECT id, m AS i, p AS j FROM {name}_back WHERE m IS NOT NULL UNION ALL SELECT id, 0, 0 FROM {source}
  UNION ALL SELECT id, len(a) + 1, len(b) + 1 FROM {source}
), {name}_parts AS (
  SELECT id, i, a[i0 + 1:i - 1] AS gone, b[j0 + 1:j - 1] AS new, a[i:i] AS kept FROM (
    SELECT id, i, j, lag(i) OVER (PARTITION BY id ORDER BY i) AS i0, lag(j) OVER (PARTITION BY id ORDER BY i) AS j0 FROM {name}_ends) e
  JOIN {source} USING (id) WHERE i0 IS NOT NULL
)"""


_MARKED = "list_transform(gone, lambda x: '-' || x) || list_transform(new, lambda x: '+' || x)"


def _count(op: str) -> str:
    words = f"list_filter(regexp_extract_all(x[2:], '{diff.WORDS}'), lambda w: trim(w, concat(' ', chr(9), chr(10), chr(12), chr(13))) <> '')"
    return f"coalesce(list_sum(list_transform(list_filter(s, lambda x: x[1] = '{op}'), lambda x: len({words}))), 0)::BIGINT"


_DIFF = f"""WITH RECURSIVE pairs AS (
  SELECT row_number() OVER () AS id, conv_id, turn, text AS base, {_TUNED} AS tuned FROM conversations WHERE role = 'assistant'
), lines AS (
  SELECT id, regexp_extract_all(base, '{diff.LINES}') AS a, regexp_extract_all(tuned, '{diff.LINES}') AS b FROM pairs
), {_subsequence("line", "lines")}, changed AS (
  SELECT row_number() OVER () AS id, id AS pair, i AS part, regexp_extract_all(array_to_string(gone, ''), '{diff.WORDS}') AS a,
         regexp_extract_all(array_to_string(new, ''), '{diff.WORDS}') AS b FROM line_parts WHERE len(gone) > 0 AND len(new) > 0
), {_subsequence("word", "changed")}, word_scripts AS (
  SELECT pair AS id, part AS i, flatten(list({_MARKED} || list_transform(kept, lambda x: '=' || x) ORDER BY w.i)) AS s
  FROM word_parts w JOIN changed USING (id) GROUP BY ALL
), scripts AS (
  SELECT id, flatten(list(coalesce(w.s, {_MARKED}) || list_transform(kept, lambda x: '=' || x) ORDER BY i)) AS s
  FROM line_parts LEFT JOIN word_scripts w USING (id, i) GROUP BY id
)
SELECT conv_id, turn, {_count("=")} AS words_kept, {_count("-")} AS words_deleted, {_count("+")} AS words_inserted,
       array_to_string(list_transform(s, lambda x: replace(replace(x, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')), chr(10)) AS script
FROM pairs JOIN scripts USING (id)"""


@query(_DIFF)
def answer_diff(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    kind, text = F.col("conv_id") % 4, F.col("text")
    tuned = (
        F.when(kind == 0, F.regexp_replace(text, " t[a-z]*", ""))
        .when(kind == 1, F.concat(F.lit("So "), F.replace(text, F.lit(". "), F.lit(".\n"))))
        .when(kind == 2, F.concat(F.substring(text, 1, 40), F.lit(" put in\nhere "), F.substr(text, F.lit(90))))
        .otherwise(text)
    )
    found = answers.answer_diff(turns, turns.withColumn("text", tuned), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "words_kept", "words_deleted", "words_inserted", diff.shown(F.col("script")).alias("script"))


# A third of the documents answer one input, the others one of some dozens per source.
_INPUTS = """inputs AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE concat(source, '/', doc_id % 50) END AS input, substr(text, 1, 40) AS response FROM documents)"""


def _inputs(spark, sf_dir):
    source = F.concat("source", F.lit("/"), (F.col("doc_id") % 50).cast("string"))
    return views.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(source).alias("input"), F.substring("text", 1, 40).alias("response")
    )


_GROUPS = f"""{_INPUTS}, groups AS (
  SELECT id, min(id) OVER (PARTITION BY input) AS input_id, count(*) OVER (PARTITION BY input) AS samples, count(*) OVER (PARTITION BY input) - 1 AS links,
         count(*) OVER (PARTITION BY input, response) AS copies, dense_rank() OVER (PARTITION BY input ORDER BY coalesce(md5(response), '')) - 1 AS response_no,
         id = min(id) OVER (PARTITION BY input, response) AS is_first, input, response FROM inputs
), sized AS (SELECT *, max(response_no) OVER (PARTITION BY input) + 1 AS responses FROM groups)"""


@query(f"WITH {_GROUPS} SELECT id, input_id, samples, links, responses, response_no, copies, is_first FROM sized")
def same_input_groups(spark, sf_dir):
    return answers.same_input_groups(_inputs(spark, sf_dir))


@query(f"WITH {_GROUPS} SELECT id, input, response, input_id, responses, response_no FROM sized WHERE responses >= 3 AND is_first")
def sampled_inputs(spark, sf_dir):
    return answers.sampled_inputs(_inputs(spark, sf_dir), 3)


# Every source is in some of the mixtures, with a weight of one to six; some mixtures want more than there is.
_MIXTURES = """mixtures AS (
  SELECT m AS mixture, source, 1 + (ascii(right(source, 1)) + m) % 6 AS weight, list_extract([7, 60, 400, 1500, 1000000], m) AS total
  FROM (SELECT DISTINCT source FROM documents) s, (SELECT unnest(range(1, 6)) AS m) t WHERE (ascii(right(source, 1)) + m) % 4 > 0)"""


def _mixtures(spark, sf_dir):
    sources = views.table(spark, sf_dir, "documents").select("source").distinct()
    named = sources.withColumn("mixture", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("_code", F.ascii(F.expr("right(source, 1)")) + F.col("mixture"))
    totals = F.array(*[F.lit(n) for n in (7, 60, 400, 1500, 1000000)])
    return named.where("_code % 4 > 0").select("mixture", "source", (1 + F.col("_code") % 6).alias("weight"), F.element_at(totals, F.col("mixture")).alias("total"))


# Shares by rounds: a source that is wanted for more than it has gives all, and the rest is shared anew among the others.
_QUOTAS = f"""{_MIXTURES}, available AS (SELECT source, count(*) AS rows FROM documents GROUP BY source
), given AS (SELECT mixture, source, weight::HUGEINT AS weight, total::HUGEINT AS total, rows::HUGEINT AS rows FROM mixtures JOIN available USING (source)
), rounds AS (
  SELECT 0 AS round, mixture, source, weight, total, rows, false AS dry FROM given
  UNION ALL
  SELECT round + 1, mixture, source, weight, total, rows, dry OR weight * rest >= rows * among FROM (
    SELECT *, total - sum(CASE WHEN dry THEN rows ELSE 0 END) OVER (PARTITION BY mixture) AS rest, sum(CASE WHEN dry THEN 0 ELSE weight END) OVER (PARTITION BY mixture) AS among
    FROM rounds WHERE round < 60) r
), final AS (
  SELECT *, (total - sum(CASE WHEN dry THEN rows ELSE 0 END) OVER (PARTITION BY mixture))::HUGEINT AS rest, sum(CASE WHEN dry THEN 0 ELSE weight END) OVER (PARTITION BY mixture)::HUGEINT AS among
  FROM rounds WHERE round = 60
), floors AS (
  SELECT *, CASE WHEN dry THEN rows ELSE (rest * weight) // among END AS low, CASE WHEN dry THEN -1 ELSE (rest * weight) % among END AS over FROM final
), quotas AS (
  SELECT mixture, source, low + CASE WHEN NOT dry AND row_number() OVER (PARTITION BY mixture ORDER BY over DESC, source) <= total - sum(low) OVER (PARTITION BY mixture) THEN 1 ELSE 0 END AS quota
  FROM floors)"""


@query(f"WITH RECURSIVE {_QUOTAS} SELECT mixture, source, quota::BIGINT AS quota FROM quotas WHERE quota > 0")
def mixture_quotas(spark, sf_dir):
    available = views.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    return mixtures.mixture_quotas(_mixtures(spark, sf_dir), available).withColumn("mixture", F.col("mixture").cast("long"))


@query(
    f"WITH RECURSIVE {_QUOTAS}, placed AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents)"
    " SELECT mixture, doc_id, source FROM placed JOIN quotas USING (source) WHERE place <= quota"
)
def source_mixtures(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = mixtures.source_mixtures(documents, _mixtures(spark, sf_dir), "doc_id")
    return found.select(F.col("mixture").cast("long").alias("mixture"), "doc_id", "source")
