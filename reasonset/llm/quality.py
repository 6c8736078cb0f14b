"""Quality rules: a table of thresholds compiled into Spark projections, without user functions.

Every rule is a line of ``RULES``: a numerator, a denominator and bounds of their ratio in thousandths,
compared as integers (cross-multiplied), so that no rounding decides. ``verdict`` folds the lines into
one boolean expression. The counts themselves are built-in functions over one text: nothing is shuffled.

Words are maximal runs of anything but blank, tab, line feed, vertical tab, form feed and carriage
return. Repeated windows are found by 64-bit hashes of their five words, in one sort per text and only
for texts in which some window comes back.

Defined results: a null text counts as an empty one; a text without words has only zeros, fails the base
rule and is not kept; repeated rows are judged one by one; null ids pass through; other columns of the
input, whatever their names, play no part in ``measure`` and pass through ``keep`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 5
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to a in is that it for on was with as be this by are at from "
    "de la le et les des en un du une que est pour qui dans au par sur pas "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als "
    "el y los se del las por con no para su es al lo"
).split()

# As they stand inside and at the start of a sentence.
STOP_FORMS = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]


@dataclass(frozen=True)
class Rule:
    """``least <= 1000 * count / per <= most``; texts of fewer than ``from_words`` words pass."""

    name: str
    count: str
    per: str
    least: int | None = None
    most: int | None = None
    from_words: int = 0

    def sql(self) -> str:
        """The rule as SQL that Spark and other engines read alike."""
        bounds = []
        if self.least is not None:
            bounds.append(f"1000 * {self.count} >= {self.least} * {self.per}")
        if self.most is not None:
            bounds.append(f"1000 * {self.count} <= {self.most} * {self.per}")
        held = " AND ".join(bounds)
        return f"(n_words < {self.from_words} OR ({held}))" if self.from_words else f"({held})"


RULES = (
    Rule("word length", "word_chars", "n_words", least=2_000, most=12_000),
    Rule("symbols per word", "n_symbols", "n_words", most=100),
    Rule("stop words", "n_stop_words", "n_words", least=30, from_words=30),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=400),
    Rule("words per line", "n_words", "n_lines", least=1_500, from_words=50),
)

BASE_FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def verdict(rules: tuple[Rule, ...] = RULES) -> str:
    """All rules as one boolean SQL expression over the counts."""
    return reduce(lambda left, right: f"{left} AND {right}", [rule.sql() for rule in rules], f"NOT {BASE_FAILED}")


def _windows(hashes: Column, n: int = WINDOW) -> Column:
    """A hash of each run of ``n`` words, from the hashes of the words."""
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
    # Single elements are read in place; a slice for each window would copy the whole array each time.
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, n)]))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the counts of the text as long columns: ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``,
    ``n_dup_lines``, ``n_stop_words``, ``n_repeat_words``.

    The arrays in between are columns of their own, so that each is made once per text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(F.col("__t"), F.lit(BLANKS))
    # Most texts hold no symbol at all; finding that out is far cheaper than rewriting the text.
    any_symbol = reduce(lambda left, right: left | right, [F.contains("__t", F.lit(c)) for c in SYMBOLS])
    h, win, ranked, at = (F.col(c) for c in ("__h", "__win", "__ranked", "__at"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return (
        docs.withColumn("__t", text)
        .withColumn("__trimmed", trimmed)
        .withColumn("__w", F.when(F.col("__trimmed") != "", F.split("__trimmed", "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>")))
        .withColumn("__lines", F.filter(F.split("__t", "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
        .withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
        .withColumn("__win", _windows(h))
        # A window's hash with its place, in order; only where a window comes back.
        .withColumn("__ranked", F.when(F.size(F.array_distinct(win)) < F.size(win), F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(none))
        .withColumn(
            "__at",
            F.sort_array(
                F.transform(
                    F.filter(ranked, lambda x, i: F.coalesce(F.get(ranked, i + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ranked, i - 1)["h"] == x["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )
        .withColumns({"__counts": _made_once({
                "n_words": F.size("__w").cast("long"),
                "word_chars": F.length(F.array_join("__w", "")).cast("long"),
                "n_symbols": F.when(any_symbol, F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).otherwise(0).cast("long"),
                "n_lines": F.size("__lines").cast("long"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                "n_stop_words": F.size(F.filter("__w", lambda w: w.isin(*STOP_FORMS))).cast("long"),
                # Each repeated window covers the words up to the next one's start, five at most.
                "n_repeat_words": F.aggregate(
                    F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1), p + WINDOW) - p)), F.lit(0).cast("long"), lambda a, b: a + b
                ),
            })})
        .select(*docs.columns, "__counts.*")
    )


def _made_once(columns: dict[str, Column]) -> Column:
    """The columns as a struct that no later condition can be moved below.

    A filter on plain expressions would be pushed through the projections, with every array written out again where it is
    used. The row number holds always; an expression with one stays where it is.
    """
    return F.when(F.monotonically_increasing_id() >= 0, F.struct(*[c.alias(name) for name, c in columns.items()]))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: the id, the counts, ``base_failed`` and ``kept``."""
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_counts(only).select("doc_id", *COUNTS).withColumns({"base_failed": F.expr(BASE_FAILED), "kept": F.expr(verdict(rules))})


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose texts pass all rules, with their columns as they are.

    The input's columns are kept inside one struct meanwhile, so that none of them can clash with a count.
    """
    held = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return with_counts(held).where(F.expr(verdict(rules))).select("row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))


_STOP_LIST = ", ".join(f"'{w}'" for w in STOP_FORMS)

OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), p AS (
  SELECT k, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5
), g AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) AS n FROM p
), s AS (
  SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS next FROM g WHERE n > 1
), r AS (
  SELECT k, sum(least(5, coalesce(next - i, 5)))::BIGINT AS n_repeat_words FROM s GROUP BY k
), c AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_filter(words, lambda x: x IN ({_STOP_LIST})))::BIGINT AS n_stop_words,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (k)
)
SELECT *, {BASE_FAILED} AS base_failed, ({verdict()}) AS kept FROM c
"""
