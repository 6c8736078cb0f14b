"""Row positions and first-n cuts over a whole table, without one task seeing all rows.

A window without a partition key would send every row to one task. Here the sort order is cut
into buckets first: a small table of row counts per bucket gives every bucket its offset, and rows
are ranked inside their bucket only. Buckets are even by construction: hash prefixes, blocks of row
numbers, or quantiles of a key. They are never a raw data value alone, so a frequent value does not
make a large bucket.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.keys import NUMBERS, key_bytes
from ..session import saved_once

# Key ranges hold about this many rows, or a hundred times as many beyond 1,024 ranges; 65,536 is the upper
# bound of their number, and with it of what reaches the driver and of the running sum over them.
RANGE_ROWS, MAX_RANGES = 10_000, 1 << 16

# Keys of a sample per range, from which ranges are cut.
SAMPLED = 32

# The first rows up to this many come from one bounded sort; an interval of so many keys is sorted on the driver.
FEW, INTERVAL = 1000, 10_000

# Whole-number keys may leave this many numbers per row unused and still be cut at equal widths.
MAX_SPAN_PER_ROW = 8

HASH_DIGITS = 3


def _seeded(key: Column, seed: int | Column) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")))


def hash_order(key: Column, seed: int | Column) -> Column:
    """Sixteen bytes that sort rows in a seeded random order."""
    return F.unhex(_seeded(key, seed))


def hash_bucket(hashed: Column, digits: int = HASH_DIGITS) -> Column:
    """The first hex digits of a :func:`hash_order`: ``16 ** digits`` even buckets in sort order."""
    return F.substring(F.hex(F.substring(hashed, 1, (digits + 1) // 2)), 1, digits)


def hash_key(key: Column, seed: int | Column) -> Column:
    """Text that sorts rows in the same order and is unique when ``key`` is."""
    return F.concat(_seeded(key, seed), F.lit(":"), key.cast("string"))


def block_bucket(row_number: Column, rows: int = 1_000_000) -> Column:
    """Blocks of a row number that already exists, such as a file's row index."""
    return F.floor(row_number / rows)


def range_count(rows: int) -> int:
    """How many key ranges a table of so many rows is cut into."""
    return max(min(1024, rows // RANGE_ROWS + 1), min(MAX_RANGES, rows // (100 * RANGE_ROWS)))


def sampled_bucket(df: DataFrame, key: str, ranges: int | None = None, times: int = 1) -> Column:
    """Even buckets of a binary key, in key order, cut at quantiles of a sample; ``times`` as many for a table that is repeated.

    Any cuts give right positions, good ones make even buckets; a key that is not unique is not cut. The cuts
    become constants of the plan, so that all uses of the bucket agree.
    """
    rows = df.count()
    ranges = ranges or range_count(rows * times)
    if ranges <= 1 or not rows:
        return F.lit(0)
    shown = df.select(F.hex(key).alias("k"))
    share = SAMPLED * ranges / rows
    found = sorted(r["k"] for r in (shown.sample(share, 11) if share < 1 else shown).collect() if r["k"] is not None)
    splits = sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []
    return split_bucket(F.hex(key), splits, "string") if splits else F.lit(0)


def range_bucket(df: DataFrame, key: str, ranges: int | None = None) -> Column:
    """At most ``ranges`` even buckets of a unique numeric key, in key order; as many as the rows ask for if not given.

    One row of figures about the key decides how, and becomes constants of the plan, so that all
    uses of the bucket agree. Whole numbers without large gaps get ranges of equal width: being
    unique, no more of them than that width can fall into one. Other keys are cut at quantiles,
    which may be approximate: any cuts give right positions, good ones make even buckets.
    """
    low, high, rows = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not rows:
        return F.lit(0)
    ranges = min(ranges or range_count(rows), MAX_RANGES)
    if ranges <= 1:
        return F.lit(0)
    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and high - low + 1 <= MAX_SPAN_PER_ROW * rows:
        width = -(-(high - low + 1) // ranges)
        return F.floor((F.col(key) - low) / width).cast("int")
    shares = F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
    splits = df.agg(F.percentile_approx(key, shares, F.lit(10 * ranges)).alias("q")).first()["q"]
    return split_bucket(F.col(key), sorted(set(splits)), df.schema[key].dataType.simpleString())


def split_bucket(key: Column, splits: Sequence, dtype: str = "bigint") -> Column:
    """The number of splits not above the key, by binary search over a constant array."""
    values = F.split(F.lit(",".join(str(s) for s in splits)), ",").cast(f"array<{dtype}>")
    strides = [1 << b for b in reversed(range(len(splits).bit_length()))]

    def search(wanted: Column) -> Column:
        return F.aggregate(
            F.array(*[F.lit(s) for s in strides]),
            F.lit(0),
            lambda found, s: F.when(F.try_element_at(values, found + s) <= wanted, found + s).otherwise(found),
        )

    # The key, which may be a hash, is worked out once and not at every step.
    return F.element_at(F.transform(F.array(key), search), 1)


def _same(left: list[str], right: list[str]) -> Column:
    condition = F.lit(True)
    for a, b in zip(left, right):
        condition = condition & F.col(a).eqNullSafe(F.col(b))
    return condition


def _bucket_offsets(keyed: DataFrame, by: list[str], buckets: list[str]) -> DataFrame:
    """Rows per (group, bucket), the rows before the bucket in its group, and the group's rows.

    This table has one row per bucket: at most ``16 ** digits`` or ``MAX_RANGES`` for each group,
    however many rows there are. Only it goes through the running sum.
    """
    counts = keyed.groupBy(*by, *buckets).agg(F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *[F.col(c).alias(f"_o_{c}") for c in [*by, *buckets]],
        F.col("_rows"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(group).alias("_total"),
    )


def with_position(
    df: DataFrame,
    order: Sequence[Column],
    buckets: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "position",
    tied: bool = False,
) -> DataFrame:
    """Adds every row's 0-based position in ``order``, per group when ``by`` is given.

    ``buckets`` must follow the order: sorting by them and then by ``order`` must give the order. With ``tied``, rows that are
    equal in the order share the position of the first of them.
    """
    by = list(by)
    names = [f"_bucket{i}" for i in range(len(buckets))]
    keyed = df.withColumns(dict(zip(names, buckets)))
    offsets = _bucket_offsets(keyed, by, names).drop("_rows", "_total")
    # The finest bucket leads the sort, where it tells most rows apart at the first comparison.
    inside = Window.partitionBy(*reversed(names), *by).orderBy(*order)
    number = F.rank() if tied else F.row_number()
    ranked = keyed.withColumn("_rank", number.over(inside))
    keys = [*by, *names]
    joined = ranked.join(offsets, _same(keys, [f"_o_{k}" for k in keys]))
    return joined.withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop(
        "_rank", "_before", *names, *[f"_o_{k}" for k in keys]
    )


def cutoffs(
    df: DataFrame, key: str, bucket: Column, take: Column, by: Sequence[str] = (), name: str = "cutoff"
) -> DataFrame:
    """The key of each group's last row to keep when ``take`` rows are kept in key order.

    ``take`` may use the group columns and ``_total``, the group's row count. Groups smaller than
    that are kept whole. Only the one bucket per group that holds the cut is ranked.
    """
    by = list(by)
    keyed = df.select(*by, key).withColumn("_bucket", bucket)
    offsets = _bucket_offsets(keyed, by, ["_bucket"])
    renamed = {f"_o_{c}": c for c in by}
    wanted = F.least(take.cast("long"), F.col("_total"))
    edge = (
        offsets.withColumnsRenamed(renamed)
        .withColumn("_wanted", wanted)
        .filter((F.col("_before") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_before") + F.col("_rows")))
        .select(
            *[F.col(c).alias(f"_o_{c}") for c in by], "_o__bucket",
            (F.col("_wanted") - F.col("_before")).alias("_nth"),
        )
    )
    if by:
        # One row per group. Once written its size is known, and with it whether it is broadcast.
        edge = saved_once(edge, "edges")
        keys = [*by, "_bucket"]
        candidates = keyed.join(edge, _same(keys, [f"_o_{k}" for k in keys]))
        group = Window.partitionBy(*by)
    else:
        # One row: its values become constants of the scan, both from the same subquery.
        values = F.struct(F.col("_o__bucket").alias("bucket"), F.col("_nth").alias("nth"))
        there = edge.select(values.alias("there")).scalar()
        candidates = keyed.filter(F.col("_bucket") == there["bucket"]).withColumn("_nth", there["nth"])
        group = Window.partitionBy(F.lit(0))
    nth = candidates.withColumn("_rank", F.row_number().over(group.orderBy(key))).filter(F.col("_rank") == F.col("_nth"))
    return nth.select(*by, F.col(key).alias(name))


def row_tie(df: DataFrame) -> Column:
    """A hash of the whole row (maps excepted), which orders rows of equal keys."""
    return F.xxhash64(*[F.col(f.name) for f in df.schema.fields if f.dataType.typeName() != "map"])


def _key_list(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _before(keys: list[str], values: Sequence[Column]) -> tuple[Column, Column]:
    """Whether a row's keys sort before the values, NULLs first, and whether they are the same."""
    before, same = F.lit(False), F.lit(True)
    for key, value in zip(keys, values):
        smaller = F.when(F.col(key).isNull(), value.isNotNull()).otherwise(F.coalesce(F.col(key) < value, F.lit(False)))
        before, same = before | (same & smaller), same & F.col(key).eqNullSafe(value)
    return before, same


def _common(low: bytes, high: bytes) -> int:
    return next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))


def nth_key(keyed: DataFrame, n: int) -> tuple[Row | None, int, int]:
    """The row of the n-th smallest ``_k``, how many are below it, and how many equal it; no row, and the count, when there are fewer.

    The interval of all keys shrinks: rows are counted by the next two bytes behind what the interval's keys have in common, and
    the count that holds the n-th key is the next interval, until it fits ``INTERVAL`` rows or is one key. Only counts, at
    most 65,792 of them, leave the scan; no key is sorted or shuffled before the last interval.
    """
    inside, below = keyed, 0
    while True:
        rows, low, high = inside.agg(F.count(F.lit(1)), F.min("_k"), F.max("_k")).first()
        if below + rows < n:
            return None, below + rows, 0
        if low == high:
            return inside.limit(1).first(), below, rows
        if rows <= INTERVAL:
            found = sorted(inside.collect(), key=lambda r: bytes(r["_k"]))
            cut = bytes(found[n - below - 1]["_k"])
            places = [i for i, r in enumerate(found) if bytes(r["_k"]) == cut]
            return found[places[0]], below + places[0], len(places)
        digits = F.substring("_k", _common(bytes(low), bytes(high)) + 1, 2)
        for part in sorted(inside.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: bytes(r["d"])):
            if below + part["rows"] >= n:
                break
            below += part["rows"]
        inside = inside.filter(digits == F.lit(bytes(part["d"])))


def first_rows(df: DataFrame, n: int, key: str | Sequence[str], derived: bool = False) -> tuple[DataFrame, int]:
    """:func:`first_n` without groups, and how many rows that are at most.

    A few rows are the head of one bounded sort. For more, the key of the last one is selected by shrinking intervals; it
    reaches the driver and becomes the constant of a filter, so that the rows themselves are neither sorted nor
    shuffled. ``derived`` says that which rows there are depends on wide columns: the keys are then written
    once instead of being worked out for every interval.
    """
    if n <= 0:
        return df.limit(0), 0
    keys = _key_list(key)
    if n <= FEW:
        return df.orderBy(*keys, row_tie(df)).limit(n), n
    keyed = df.select(*keys, key_bytes(df.schema, keys).alias("_k"))
    cut, below, equal = nth_key(saved_once(keyed, "keys") if derived else keyed, n)
    if cut is None:
        return df, below
    values = [F.lit(cut[k]).cast(df.schema[k].dataType) for k in keys]
    before, same = _before(keys, values)
    if below + equal == n:
        return df.filter(before | same), n
    wanted, ties = n - below, df.filter(same)
    if keys == ["_tie"]:
        # Rows alike in all columns: any of them will do.
        return df.filter(before).unionByName(ties.limit(wanted)), n
    some, _ = first_rows(ties.withColumn("_tie", row_tie(df)), wanted, "_tie", derived)
    return df.filter(before).unionByName(some.drop("_tie")), n


def first_n(
    df: DataFrame, n: int | Column, key: str | Sequence[str], by: Sequence[str] = (), derived: bool = False
) -> DataFrame:
    """The first ``n`` rows in key order, per group when ``by`` is given; their order is not defined.

    ``key`` is one column or several, of types that :func:`~reasonset.functions.keys.key_bytes` takes. NULLs come first. Without groups, rows of equal
    keys are taken in the order of :func:`row_tie`, so that there are never more than ``n``.

    With groups the keys are unique together, and a cut-off key per group is found. The rows
    themselves are filtered where they are, without a sort or shuffle. ``derived`` says that which rows there are
    depends on wide columns, such as the length of a text; the keys are then written once instead of being
    worked out for every use.
    """
    by = list(by)
    if not by:
        if not isinstance(n, int):
            raise TypeError("without groups the number of rows is an int")
        return first_rows(df, n, key, derived)[0]
    kinds = [df.schema[k].dataType.typeName() for k in _key_list(key)]
    if len(kinds) > 1 or kinds[0] not in (*NUMBERS, "binary"):
        keyed = df.withColumn("_key", key_bytes(df.schema, _key_list(key)))
        return first_n(keyed, n, "_key", by, derived).drop("_key")
    key = _key_list(key)[0]
    take = F.lit(n) if isinstance(n, int) else n
    keys = df.select(*by, key)
    if derived:
        keys = saved_once(keys, "keys")
    bucket = sampled_bucket(keys, key) if kinds == ["binary"] else range_bucket(keys, key)
    cuts = cutoffs(keys, key, bucket, take, by, "_cutoff")
    # One row per group, written so that its true size decides on a broadcast: the rows need not
    # be shuffled to find that out.
    cuts = saved_once(cuts.select(*[F.col(c).alias(f"_o_{c}") for c in by], "_cutoff"), "cutoffs")
    joined = df.join(cuts, _same(by, [f"_o_{c}" for c in by]))
    return joined.filter(F.col(key) <= F.col("_cutoff")).drop("_cutoff", *[f"_o_{c}" for c in by])


def with_key_position(df: DataFrame, key: str, by: Sequence[str], name: str = "position") -> DataFrame:
    """Adds how many rows of the row's group have a smaller key; the key is of a type that :func:`first_n` takes.

    The rows are read three times: they should be those of a written table.
    """
    kind = df.schema[key].dataType.typeName()
    if kind not in (*NUMBERS, "binary"):
        keyed = df.withColumn("_key", key_bytes(df.schema, [key]))
        return with_key_position(keyed, "_key", by, name).drop("_key")
    bucket = sampled_bucket(df, key) if kind == "binary" else range_bucket(df, key)
    return with_position(df, [F.col(key)], [bucket], by, name, tied=True)


def key_text(df: DataFrame, key: str | Sequence[str]) -> Column:
    """What a row's hash is made of: its key column, or several as the text of their bytes."""
    keys = _key_list(key)
    return F.col(keys[0]) if len(keys) == 1 else F.hex(key_bytes(df.schema, keys))


def hashed_cutoff(df: DataFrame, key: str | Sequence[str], seed: int, take: Column) -> Column:
    """The hash key of the last of ``take`` rows in seeded random order, as a scalar subquery."""
    hashed = df.select(hash_key(key_text(df, key), seed).alias("_hash"))
    return cutoffs(hashed, "_hash", F.substring("_hash", 1, HASH_DIGITS), take).select("cutoff").scalar()
