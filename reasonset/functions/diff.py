"""Edit scripts between two texts by a longest common subsequence, in array functions only.

The dynamic programme keeps, per length of a common subsequence, where the shortest prefix of the second list that has one
ends. A token of the first list changes these thresholds only where it occurs in the second, so that a row of the programme costs as
much as it has matches. The rows are kept, and walked back from the end. Lines are compared first; runs of lines that
changed on both sides are compared word by word. Everything stays inside the row of its texts: no shuffle, and memory by
the changed lines, not by the product of two whole texts.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of a script.
KEEP, DELETE, INSERT = "=", "-", "+"

# Lists of tokens that give the text again when joined: lines with their line feed, words with the blanks behind them.
LINES = r"[^\n]*\n|[^\n]+"
WORDS = r"[^ \t\n\r\f]+[ \t\n\r\f]*|[ \t\n\r\f]+"

_END = 2**31 - 1
_SCRIPT = "array<struct<op:string,text:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _rows(a: Column, b: Column) -> Column:
    """For every prefix of ``a`` its thresholds: where the shortest prefix of ``b`` with 1, 2, … common tokens ends."""

    def moved(thresholds: Column, places: Column) -> Column:
        def one(until: Column, k: Column) -> Column:
            since = F.when(k == 0, 0).otherwise(F.try_element_at(thresholds, k))
            return F.least(until, F.array_min(F.filter(places, lambda p: p > since)))

        longer = F.transform(F.concat(thresholds, F.array(F.lit(_END))), one)
        return F.filter(longer, lambda t: t < _END)

    def step(state: Column, token: Column) -> Column:
        places = F.filter(F.transform(b, lambda other, j: F.when(other == token, j + 1)), lambda p: p.isNotNull())
        last = state["last"]
        now = _let(places, lambda p: F.when(F.size(p) == 0, last).otherwise(moved(last, p)))
        return _let(now, lambda t: F.struct(t.alias("last"), F.array_append(state["rows"], t).alias("rows")))

    none = F.array().cast("array<int>")
    return F.aggregate(a, F.struct(none.alias("last"), F.array().cast("array<array<int>>").alias("rows")), step, lambda s: s["rows"])


def matches(a: Column, b: Column) -> Column:
    """A longest common subsequence of two lists as places (``i``, ``j``) from 1.

    Of several, the one found from the end by leaving out a token of ``a`` where that loses nothing, then one of ``b``.
    """

    def common(row: Column, until: Column) -> Column:
        return F.size(F.filter(row, lambda t: t <= until))

    def walked(rows: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            here = F.element_at(rows, i)
            before = F.coalesce(F.try_element_at(rows, F.when(i > 1, i - 1)), F.array().cast("array<int>"))

            def matched(k: Column) -> Column:
                j = F.try_element_at(here, F.when(k > 0, k))
                pair = F.struct(i.alias("i"), j.alias("j"))
                found = F.struct((j - 1).alias("until"), F.array_append(state["pairs"], pair).alias("pairs"))
                return F.when(k == common(before, state["until"]), state).otherwise(found)

            return _let(common(here, state["until"]), matched)

        start = F.struct(F.size(b).alias("until"), F.array().cast("array<struct<i:int,j:int>>").alias("pairs"))
        back = F.when(F.size(a) > 0, F.sequence(F.size(a), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(back, start, step, lambda s: F.reverse(s["pairs"]))

    return _let(_rows(a, b), walked)


def _segments(a: Column, b: Column, pairs: Column) -> Column:
    """What stands before each match, and behind the last: (deleted, inserted, kept), lists of tokens."""
    ends = F.concat(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))), pairs, F.array(F.struct((F.size(a) + 1).alias("i"), (F.size(b) + 1).alias("j"))))

    def segment(k: Column) -> Column:
        low, high = F.element_at(ends, k), F.element_at(ends, k + 1)
        return F.struct(
            F.slice(a, low["i"] + 1, high["i"] - low["i"] - 1).alias("deleted"),
            F.slice(b, low["j"] + 1, high["j"] - low["j"] - 1).alias("inserted"),
            F.slice(a, high["i"], 1).alias("kept"),
        )

    return _let(ends, lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), segment))


def _flat(segments: Column, changed: Callable[[Column], Column]) -> Column:
    """The script of segments; ``changed`` gives that of a segment with both sides."""

    def written(s: Column) -> Column:
        of = lambda name, op: F.transform(s[name], lambda t: F.struct(F.lit(op).alias("op"), t.alias("text")))
        both = (F.size(s["deleted"]) > 0) & (F.size(s["inserted"]) > 0)
        plain = F.concat(of("deleted", DELETE), of("inserted", INSERT))
        return F.concat(F.when(both, changed(s)).otherwise(plain), of("kept", KEEP))

    return F.flatten(F.transform(segments, written))


def _plain(s: Column) -> Column:
    of = lambda name, op: F.transform(s[name], lambda t: F.struct(F.lit(op).alias("op"), t.alias("text")))
    return F.concat(of("deleted", DELETE), of("inserted", INSERT))


def token_script(a: Column, b: Column) -> Column:
    """The edits that turn one list of tokens into another, deletions before insertions: ``op`` and ``text``."""
    return _let(matches(a, b), lambda pairs: _flat(_segments(a, b, pairs), _plain)).cast(_SCRIPT)


def _by_words(s: Column) -> Column:
    words = lambda name: tokens(F.array_join(s[name], ""), WORDS)
    return _let(words("deleted"), lambda a: _let(words("inserted"), lambda b: token_script(a, b)))


def text_script(left: Column, right: Column) -> Column:
    """The edits from one text to another: whole lines where lines are kept, added or removed, words where they are changed.

    The texts of kept and deleted parts joined give the left text, those of kept and inserted parts the right one. A
    null text counts as an empty one.
    """
    by_line = lambda a, b: _let(matches(a, b), lambda pairs: _flat(_segments(a, b, pairs), _by_words))
    lines = _let(tokens(left, LINES), lambda a: _let(tokens(right, LINES), lambda b: by_line(a, b)))
    same = F.coalesce(left, F.lit("")).eqNullSafe(F.coalesce(right, F.lit("")))
    whole = F.transform(tokens(left, LINES), lambda t: F.struct(F.lit(KEEP).alias("op"), t.alias("text")))
    return F.when(same, whole).otherwise(lines).cast(_SCRIPT)


def applied(script: Column, op: str) -> Column:
    """The left text of a script for ``DELETE``, the right one for ``INSERT``."""
    return F.array_join(F.transform(F.filter(script, lambda e: e["op"].isin(KEEP, op)), lambda e: e["text"]), "")


def words_of(script: Column, op: str) -> Column:
    """How many words the script keeps, deletes or inserts."""
    count = F.aggregate(
        F.filter(script, lambda e: e["op"] == op), F.lit(0), lambda n, e: n + F.size(F.filter(tokens(e["text"], WORDS), lambda w: F.trim(F.translate(w, "\t\n\r\f", "    ")) != ""))
    )
    return count.cast("long")


def shown(script: Column) -> Column:
    """The script as text: each part behind its letter, one part per line, line feeds inside parts as ``\\n``."""
    return F.array_join(F.transform(script, lambda e: F.concat(e["op"], F.replace(F.replace(e["text"], F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))), "\n")
