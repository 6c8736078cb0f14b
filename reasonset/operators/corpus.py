"""Corpus jobs over nested conversations: browsing, token budgets and subsets."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, messages
from ..functions import text as texts
from ..session import saved_once
from . import turns as turn_ops
from .position import FEW, first_n, first_rows, row_tie, with_key_position
from .predicates import budget, corpus_filter, token_budget

# Binary digits of the largest number of budgets that a source may have.
DIGITS = 31


def with_tokens(df: DataFrame) -> DataFrame:
    answer = messages.first_text(F.col("messages"), fixed.ASSISTANT_ROLES)
    return df.withColumns(
        {
            "_total_tokens": messages.total_tokens(F.col("messages")),
            "_assistant_tokens": messages.text_tokens(answer),
        }
    )


def browse_table(df: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    """What a browsing page shows of each example, behind the key columns that name it."""
    return df.select(
        *([key] if isinstance(key, str) else key),
        "difficulty",
        F.coalesce("source", F.lit(fixed.NOT_AVAILABLE)).alias("source"),
        F.coalesce("domain", F.lit(fixed.NOT_AVAILABLE)).alias("domain"),
        messages.browse_tokens(F.col("messages")).alias("tokens"),
        messages.preview(F.col("messages")).alias("preview"),
    )


def page(
    df: DataFrame, number: int, size: int = 50, key: str | Sequence[str] = "id", after: int | None = None
) -> DataFrame:
    """Page ``number`` (from 1) in key order, sorted; a page shorter than ``size`` is the last one.

    Keys and ties are those of :func:`first_n`, so that the pages of any table join up. ``after``, the last key of the
    page before (one column, unique and not NULL), makes any page as cheap as the first.
    """
    if after is not None:
        return df.filter(F.col(key) > after).orderBy(key).limit(size)
    keys = [key] if isinstance(key, str) else list(key)
    start = (number - 1) * size
    order = [*[F.col(k) for k in keys], row_tie(df)]
    if start + size <= FEW:
        return df.orderBy(*order).offset(start).limit(size)
    upto, rows = first_rows(df, start + size, keys)
    # The last rows of those up to the page's end: a sort of one page, however far in it is.
    last = upto.orderBy(*[o.desc() for o in order]).limit(max(rows - start, 0))
    return last.orderBy(*order)


def make_subset(
    df: DataFrame,
    max_tokens: int,
    limit: int,
    max_assistant_tokens: int | None = None,
    source: str | None = None,
    domain: str | None = None,
    scan_cap: int | None = None,
    key: str | Sequence[str] = "id",
) -> DataFrame:
    """The first ``limit`` examples, in key order, that match the names and fit the token budget.

    A corpus without an id is taken in stored order by the keys ``("file_name", "row_index")`` of
    ``read_corpus(order_key=True)``. ``scan_cap`` looks at that many matching rows only, in key order.
    """
    rows = df.filter(corpus_filter(source=source, domain=domain))
    if scan_cap is not None:
        rows = first_n(rows, scan_cap, key)
    return first_n(token_budget(with_tokens(rows), max_tokens, max_assistant_tokens), limit, key, derived=True)


def make_subset_of_turns(
    examples: DataFrame,
    turns: DataFrame,
    max_tokens: int,
    limit: int,
    max_assistant_tokens: int | None = None,
    source: str | None = None,
    domain: str | None = None,
    key: str = "id",
) -> DataFrame:
    """The same subset when turns are rows of their own.

    Conversations are chosen from their token counts; only the turns of the chosen ones are nested,
    each into one row, so that there are never more rows than ``limit``.
    """
    rows = examples.filter(corpus_filter(source=source, domain=domain))
    sized = turn_ops.with_tokens(turns, key).filter(budget(max_tokens, max_assistant_tokens))
    chosen = first_n(rows.join(sized, key), limit, key)
    return turn_ops.nest_turns(turns.join(chosen, key), key, keep=[c for c in chosen.columns if c != key])


def subset_per_source(df: DataFrame, n: int, key: str | Sequence[str] = "id", by: Sequence[str] = ("source",)) -> DataFrame:
    """The first ``n`` rows of every source, all sources in one job."""
    return first_n(df, n, key, by)


def subset_sweep(df: DataFrame, requests: Sequence[dict], key: str = "id") -> DataFrame:
    """One subset per request (source, max_tokens, limit), all from one scan.

    Each row is copied to the requests it satisfies; the requests are constants of the plan, so
    that neither a join nor a broadcast is needed.
    """
    def request(number: int, wanted: dict) -> Column:
        source, max_tokens = wanted.get("source", "all"), wanted["max_tokens"]
        fits = F.col("_total_tokens") <= max_tokens
        if source != "all":
            fits = fits & (F.col("source") == source)
        fields = F.struct(
            F.lit(number).alias("request"),
            F.lit(source).alias("wanted_source"),
            F.lit(max_tokens).cast("long").alias("max_tokens"),
            F.lit(wanted["limit"]).cast("long").alias("limit"),
        )
        return F.when(fits, fields)

    matched = F.array_compact(F.array(*[request(i, r) for i, r in enumerate(requests)]))
    spread = df.select("*", F.explode(matched).alias("_request")).select("*", "_request.*").drop("_request")
    return first_n(spread, F.col("limit"), key, by=["request", "limit"], derived=True)


def _even_blocks(block: Callable[[int], Column], upto: Column) -> Column:
    """A row for every height of which the block number is even: (``_height``, ``_block``), blocks being of ``2 ** height`` places.

    ``upto`` is the largest number of places; heights beyond it have no block.
    """
    blocks = [
        F.when((F.shiftright(upto, h) > 0) & (block(h) % 2 == 0), F.struct(F.lit(h).alias("_height"), block(h).alias("_block")))
        for h in range(DIGITS)
    ]
    return F.inline(F.array_compact(F.array(*blocks)))


def subset_sweep_of(df: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    """One subset per row of a table of requests (``request``, ``wanted_source``, ``max_tokens``, ``limit``).

    The budgets of a source cut token counts into intervals, numbered upwards, and a budget takes all intervals up to its own. These are
    one block of 1, 2, 4, ... intervals for every binary digit of their number. Of a block only as many first rows are kept as the largest limit that
    uses it, and each distinct budget of a source merges the heads of its blocks once, into a list of as many first rows as its largest limit. A
    request takes the head of its budget's list. So no row meets requests that do not take it, and no request is part of the plan. ``all``
    stands for every source.
    """
    asked = saved_once(requests.where("`limit` > 0").select("request", "wanted_source", "max_tokens", "limit"), "requests")
    # Budgets per source, ascending, each with its largest limit and with the largest limit of those that are not below it.
    levels = asked.groupBy("wanted_source", "max_tokens").agg(F.max("limit").alias("_own"))
    upward = Window.partitionBy("wanted_source").orderBy(F.desc("max_tokens"))
    levels = levels.withColumn("_most", F.max("_own").over(upward.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    by_source = levels.groupBy("wanted_source").agg(F.array_sort(F.collect_list(F.struct("max_tokens", "_most", "_own"))).alias("_levels"))
    by_source = saved_once(by_source.withColumnRenamed("wanted_source", "_ask"), "levels")
    spread = df.select("source", key, "_total_tokens").withColumn("_ask", F.explode(F.array_distinct(F.array(F.col("source"), F.lit("all")))))
    # The first budget that is not below the tokens, by halving.
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(DIGITS))])
    too_small = F.aggregate(
        halves, F.lit(0), lambda n, h: F.when(F.try_element_at(F.col("_levels"), n + h)["max_tokens"] < F.col("_total_tokens"), n + h).otherwise(n)
    )
    placed = spread.join(by_source, "_ask").withColumn("_place", too_small).withColumn("_count", F.size("_levels")).where("_place < _count")
    most = F.element_at(F.col("_levels"), F.col("_place") + 1)["_most"]
    narrow = saved_once(placed.select(key, "_ask", "_place", "_count", most.alias("_most")), "places")
    some = saved_once(first_n(narrow, F.col("_most"), key, by=["_ask", "_place", "_most"]).drop("_most"), "some")

    place = F.col("_place")
    budgets = by_source.select("_ask", F.posexplode("_levels").alias("_place", "_level")).select(
        "_ask", F.col("_level.max_tokens").alias("_budget"), F.col("_level._own").alias("_own"), _even_blocks(lambda h: F.shiftright(place + 1, h) - 1, place + 1)
    )
    blocks = saved_once(budgets.groupBy("_ask", "_height", "_block").agg(F.max("_own").alias("_largest")), "blocks")
    inside = some.select(key, "_ask", _even_blocks(lambda h: F.shiftright(place, h), F.col("_count"))).join(blocks, ["_ask", "_height", "_block"])
    heads = with_key_position(saved_once(inside, "inside"), key, ["_ask", "_height", "_block"], "_at").where("_at < _largest")
    # Merge joins: as files these tables are a small part of their size in memory, too small to decide on a broadcast.
    merged = budgets.join(heads.hint("merge"), ["_ask", "_height", "_block"]).where("_at < _own").select("_ask", "_budget", "_own", key)
    lists = with_key_position(saved_once(merged, "merged"), key, ["_ask", "_budget"], "_at").where("_at < _own")
    lists = saved_once(lists.select("_ask", "_budget", key, "_at"), "lists")

    def taken(some_asked: DataFrame) -> DataFrame:
        same = (F.col("_ask") == F.col("wanted_source")) & (F.col("_budget") == F.col("max_tokens")) & (F.col("_at") < F.col("limit"))
        return lists.join(some_asked.hint("merge"), same).select(key, "request", "wanted_source", "max_tokens", "limit")

    # Rows of the table that share a request's number and limit are one request: their union is cut.
    shared = asked.groupBy("request", "limit").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    shared = saved_once(shared.select(F.col("request").alias("_o_request"), F.col("limit").alias("_o_limit")), "shared")
    is_shared = F.col("request").eqNullSafe(F.col("_o_request")) & (F.col("limit") == F.col("_o_limit"))
    chosen = taken(asked.join(shared, is_shared, "left_anti"))
    if not shared.isEmpty():
        union = saved_once(taken(asked.join(shared, is_shared, "left_semi")), "union")
        chosen = chosen.unionByName(first_n(union, F.col("limit"), key, by=["request", "limit"]))
    # Written, so that the true size decides whether they are broadcast: the chosen rows then need no shuffle.
    rows = saved_once(df.join(lists.select(key).distinct(), key, "left_semi"), "rows")
    return rows.join(chosen, key)


def subset_stats(df: DataFrame) -> DataFrame:
    """Rows and mean token counts of a subset; the means are 0 when it is empty."""
    def mean(column: str) -> Column:
        return F.coalesce(F.avg(column), F.lit(0.0))

    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        mean("_total_tokens").alias("avg_total_tokens"),
        mean("_assistant_tokens").alias("avg_assistant_tokens"),
    )


def scan_funnel(
    df: DataFrame, max_tokens: int, limit: int, max_assistant_tokens: int | None = None
) -> DataFrame:
    """Rows scanned, kept and rejected by the budget, the pass rate, and what is missing to ``limit``."""
    scanned = F.count(F.lit(1))
    kept = F.count_if(budget(max_tokens, max_assistant_tokens))
    return df.agg(scanned.alias("scanned"), kept.alias("kept")).select(
        "scanned",
        "kept",
        (F.col("scanned") - F.col("kept")).alias("rejected"),
        F.coalesce(F.try_divide(F.col("kept") * 100.0, F.col("scanned").cast("double")), F.lit(0.0)).alias("pass_rate"),
        F.greatest(F.lit(limit) - F.col("kept"), F.lit(0)).cast("long").alias("shortfall"),
    )


def sample_documents_of_turns(examples: DataFrame, turns: DataFrame, n: int = 10, key: str = "id") -> DataFrame:
    """The same documents when turns are rows of their own: only the chosen ones' turns are read on."""
    chosen = examples.orderBy(key).limit(n)
    texts = turn_ops.first_turns(turns.join(chosen.select(key), key, "left_semi"), key)
    return sample_documents(chosen.join(texts, key), n, key)


def sample_documents(df: DataFrame, n: int = 10, key: str | Sequence[str] = "id") -> DataFrame:
    """The first ``n`` examples in key order as readable documents.

    Takes (source, domain, difficulty, user_text, assistant_text); gives (sample, document).
    """
    split = texts.split_reasoning(F.col("assistant_text"))
    reasoning = F.when(split["reasoning"] == "", fixed.NO_REASONING).otherwise(split["reasoning"])
    keys = [key] if isinstance(key, str) else list(key)
    head = df.orderBy(*keys).limit(n)
    numbered = head.withColumn("sample", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)).cast("long"))
    document = texts.fill(
        fixed.SAMPLE_DOCUMENT,
        sample=F.col("sample").cast("string"),
        source=F.coalesce("source", F.lit("unknown")),
        domain=F.coalesce("domain", F.lit("unknown")),
        difficulty=F.coalesce(F.col("difficulty").cast("string"), F.lit(fixed.NOT_AVAILABLE)),
        user_text=F.col("user_text"),
        reasoning=reasoning,
        output=split["output"],
    )
    return numbered.select("sample", document.alias("document"))
