"""Strict numeric conversion, linear scaling and null conventions of stored values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest and largest value and the Spark type of each integer type.
INTEGERS = {
    "i8": (-128, 127, "tinyint"), "u8": (0, 255, "smallint"), "i16": (-32768, 32767, "smallint"), "u16": (0, 65535, "int"),
    "i32": (-(1 << 31), (1 << 31) - 1, "int"), "u32": (0, (1 << 32) - 1, "bigint"), "i64": (-(1 << 63), (1 << 63) - 1, "bigint"), "u64": (0, (1 << 64) - 1, "decimal(20,0)"),
}


def fits(x: Column, kind: str, real: bool) -> Column:
    """Whether x, rounded half away from zero if it is real, is in the range of an integer type."""
    low, high, _ = INTEGERS[kind]
    if real:
        # The bound above is a power of two, so it is exact as a double; NaN compares as the largest.
        whole = F.round(x)
        return ~F.isnan(x) & (whole >= F.lit(float(low))) & (whole < F.lit(float(high + 1)))
    return x.cast("decimal(38,0)").between(F.lit(low).cast("decimal(38,0)") if abs(low) < 1 << 63 else F.expr(f"{low}BD"), F.expr(f"{high}BD"))


def to_integer(x: Column, kind: str, real: bool = True, on_error: str = "raise") -> Column:
    """x as an integer type: rounded half away from zero and range-checked.

    on_error: "raise" ends the query with Overflow or NanToInt; "null" gives null.
    """
    good, kind_of = fits(x, kind, real), INTEGERS[kind][2]
    whole = F.round(x) if real else x
    bad = F.lit(None).cast(kind_of)
    if on_error == "raise":
        bad = F.raise_error(F.when(F.isnan(x), "NanToInt").otherwise("Overflow") if real else F.lit("Overflow")).cast(kind_of)
    return F.when(x.isNull(), F.lit(None).cast(kind_of)).when(good, whole.cast(kind_of)).otherwise(bad)


def cast_class(x: Column, kind: str) -> Column:
    """ok, NanToInt or Overflow: how a real x converts to an integer type."""
    return F.when(F.isnan(x), "NanToInt").when(fits(x, kind, True), "ok").otherwise("Overflow")


def exact_as_double(x: Column) -> Column:
    """Whether a bigint survives the way to double and back; 2^63 would saturate, so it is guarded."""
    d = x.cast("double")
    return (d < F.lit(9.223372036854775808e18)) & (d.cast("bigint") == x)


def exact_as_float(x: Column) -> Column:
    """Whether a double survives the way to float and back."""
    return F.isnan(x) | (x.cast("float").cast("double") == x)


def physical(stored: Column, scale: float = 1.0, zero: float = 0.0) -> Column:
    """zero + scale * stored, in this order, in double precision."""
    return F.lit(float(zero)) + F.lit(float(scale)) * stored


def physical_integer(stored: Column, zero: int, kind: str = "i64") -> Column:
    """stored + zero in whole numbers: the conventions for unsigned integers and signed bytes."""
    wide = "decimal(38,0)" if kind == "u64" else "bigint"
    return (stored.cast(wide) + F.lit(zero).cast(wide) if abs(zero) < 1 << 63 else stored.cast(wide) + F.expr(f"{zero}BD")).cast(INTEGERS[kind][2])


#: The zero that stands for each unsigned type, or for signed bytes.
ZEROS = {"u16": 1 << 15, "u32": 1 << 31, "u64": 1 << 63, "i8": -128}


def unsigned(stored: Column, kind: str) -> Column:
    """The value of a stored signed integer under the unsigned convention of kind."""
    return physical_integer(stored, ZEROS[kind], kind)


def stored_value(value: Column, scale: float = 1.0, zero: float = 0.0) -> Column:
    """(value - zero) / scale, before conversion to the stored type."""
    return (value - F.lit(float(zero))) / F.lit(float(scale))


def null_if(raw: Column, blank, value: Column) -> Column:
    """value, or null where the raw stored value, before scaling, is the blank."""
    return F.when(raw == F.lit(blank), F.lit(None)).otherwise(value)


def null_if_nan(x: Column) -> Column:
    """x, or null where it is not a number."""
    return F.when(~F.isnan(x), x)


def sentinel(x: Column, value: float) -> Column:
    """x, or value where x is null or not a number."""
    return F.when(x.isNull() | F.isnan(x), F.lit(value)).otherwise(x)
