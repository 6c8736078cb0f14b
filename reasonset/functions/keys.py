"""Several sortable columns as one: bytes that sort as the columns do, NULLs first."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, StructType

NUMBERS = ("byte", "short", "integer", "long", "float", "double")


def _long_bytes(value: Column) -> Column:
    """Eight bytes of a whole number; the sign is turned so that negative numbers come first."""
    return F.unhex(F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))), 16, "0"))


def _double_rank(value: Column) -> Column:
    """A whole number for every double, in their order: exponent and mantissa, negative for negative ones; NaN comes last."""
    value = value.cast("double")
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("int")
    two = lambda e: F.pow(F.lit(2.0), e)
    # The logarithm may be rounded over a power of two.
    exponent = F.when(two(guess) > size, guess - 1).when(two(guess + 1) <= size, guess + 1).otherwise(guess)
    mantissa = ((size / two(exponent) - 1) * F.lit(2.0**52)).cast("long")
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + mantissa
    rank = F.when(size < 2.0**-1022, (size / F.lit(2.0**-1074)).cast("long")).otherwise(normal)
    signed = F.when(value < 0, -rank).otherwise(rank)
    top = F.lit(2**63 - 2).cast("long")
    special = F.when(F.isnan(value), top + 1).when(value == float("inf"), top).when(value == float("-inf"), -top).when(value == 0, F.lit(0).cast("long"))
    return F.coalesce(special, signed)


def _bytes(value: Column, dtype: DataType) -> Column:
    kind = dtype.typeName()
    if kind in ("byte", "short", "integer", "long"):
        return _long_bytes(value)
    if kind in ("float", "double"):
        return _long_bytes(_double_rank(value))
    if kind == "boolean":
        return _long_bytes(value.cast("int"))
    if kind == "date":
        return _long_bytes(F.unix_date(value))
    if kind == "timestamp":
        return _long_bytes(F.unix_micros(value))
    if kind == "timestamp_ntz":
        micros = (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("long")
        return _long_bytes(F.unix_date(value.cast("date")).cast("long") * 86_400_000_000 + (F.hour(value) * 60 + F.minute(value)).cast("long") * 60_000_000 + micros)
    if isinstance(dtype, DecimalType) and dtype.precision <= 18:
        return _long_bytes(value * F.lit(10**dtype.scale).cast("decimal(19, 0)"))
    if kind == "string":
        # A zero ends the text; one inside it is followed by a byte above what begins the next column.
        return F.concat(F.encode(F.replace(value, F.lit("\0"), F.lit("\0ÿ")), "UTF-8"), F.unhex(F.lit("00")))
    raise TypeError(f"keys of type {dtype.simpleString()} are not supported")


def key_bytes(schema: StructType, keys: Sequence[str]) -> Column:
    """The order of several columns as the order of one binary column, NULLs first, equal only where all columns are.

    Takes whole numbers, floating-point numbers, decimals of at most 18 digits, texts, booleans, dates and timestamps.
    """
    one, none = F.unhex(F.lit("01")), F.unhex(F.lit("00"))
    parts = [F.coalesce(F.concat(one, _bytes(F.col(k), schema[k].dataType)), none) for k in keys]
    return F.concat(*parts) if len(parts) > 1 else parts[0]
