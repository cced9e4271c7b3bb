"""Fields of ASCII tables, logical values, bits, characters, complex pairs and wildcards."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AmbiguousColumn, NoSuchColumn


def field(row: Column, start: int, width: int) -> Column:
    """The characters of a field; start counts from 1."""
    return F.substring(row, start, width)


def field_null(text: Column, null: str | None = None) -> Column:
    """Whether a field is null: blank, or equal to the null string without blanks around both."""
    inner = F.trim(text)
    return (inner == "") | (inner == F.lit(null.strip())) if null is not None else inner == ""


def parse_integer(text: Column) -> Column:
    """A bigint from an optional sign and digits; null if it is anything else."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))


_REAL = r"^([+-]?)(\d*)(?:(\.)(\d*))?(?:[EeDd]([+-]?\d+)|([+-]\d+))?$"


def parse_real(text: Column, decimals: int = 0) -> Column:
    """A double from a FORTRAN number; null if it is none or not finite.

    Without a point, the last ``decimals`` digits are the fraction.  An exponent follows E or D, or
    is a bare signed number.
    """
    t = F.trim(text)
    part = lambda n: F.regexp_extract(t, _REAL, n)
    whole, point, fraction = part(2), part(3), part(4)
    power = F.coalesce(F.when(part(5) != "", part(5)).when(part(6) != "", part(6)), F.lit("0"))
    shift = F.when(point == "", F.lit(decimals)).otherwise(F.length(fraction))
    number = F.concat(part(1), whole, fraction, F.lit("e"), (power.try_cast("int") - shift).cast("string")).try_cast("double")
    good = t.rlike(_REAL) & ((F.length(whole) + F.length(fraction)) > 0)
    return F.when(good & (F.abs(number) < F.lit(float("inf"))), number)


def write_field(text: Column, width: int, left: bool = False) -> Column:
    """text padded to width: numbers to the right, text to the left; an error if it does not fit."""
    padded = F.rpad(text, width, " ") if left else F.lpad(text, width, " ")
    return F.when(F.length(text) <= width, padded).otherwise(F.raise_error(F.lit("FieldOverflow")))


def logical(code: Column) -> Column:
    """T or t is true, NUL or an empty text is null, all else is false."""
    return F.when((code == "") | (code == "\0"), F.lit(None).cast("boolean")).otherwise(code.isin("T", "t"))


def logical_code(value: Column) -> Column:
    """T, F or NUL."""
    return F.when(value.isNull(), "\0").when(value, "T").otherwise("F")


def unpack_bits(byte: Column, count: int = 8) -> Column:
    """The bits of a byte from the highest on, as an array of 0 and 1."""
    return F.array(*[F.shiftright(byte, 7 - k).bitwiseAND(F.lit(1)).cast("int") for k in range(count)])


def pack_bits(bits: Column, count: int = 8) -> Column:
    """The byte of an array of 0 and 1, from the highest bit on."""
    return sum((F.get(bits, F.lit(k)) * F.lit(1 << (7 - k)) for k in range(count)), F.lit(0))


def characters(raw: Column, width: int) -> Column:
    """A text that ends at the first NUL, padded with blanks to width; null if it begins with NUL."""
    upto = F.substring_index(raw, "\0", 1)
    return F.when(~F.startswith(raw, F.lit("\0")), F.rpad(upto, width, " "))


def encode_characters(text: Column, width: int) -> Column:
    """width characters: cut or padded with blanks, NUL written as a blank."""
    return F.rpad(F.translate(F.coalesce(text, F.lit("")), "\0", " "), width, " ")


def substrings(text: Column, width: int, count: int) -> Column:
    """count texts of width characters each, without trailing blanks."""
    return F.array(*[F.rtrim(F.substring(text, 1 + k * width, width)) for k in range(count)])


def complex_pairs(values: Column) -> Column:
    """An array (re, im, re, im, ...) as an array of structs."""
    at = F.sequence(F.lit(0), (F.size(values) / 2).cast("int") - 1)
    return F.transform(at, lambda i: F.struct(F.get(values, 2 * i).alias("re"), F.get(values, 2 * i + 1).alias("im")))


def reshape(values: Column, shape: list[int]) -> Column:
    """A flat array as nested arrays; the first axis of shape varies fastest, so it is innermost."""
    out, size = values, 1
    for n in shape[:-1]:
        parent, size = out, n
        out = F.transform(F.sequence(F.lit(0), (F.size(parent) / size).cast("int") - 1), lambda i, p=parent, s=size: F.slice(p, i * s + 1, s))
    return out


def wildcard(pattern: str) -> str:
    """The regular expression of a column pattern: * any run, ? one character, # one or more digits."""
    own = {"*": ".*", "?": ".", "#": "[0-9]+"}
    return "(?is)^" + "".join(own.get(c, re.escape(c)) for c in pattern) + "$"


def matches(name: Column, pattern: str) -> Column:
    """Whether a name fits a pattern, without regard to case."""
    return name.rlike(wildcard(pattern))


def resolve(names: list[str], pattern: str) -> str:
    """The one name that fits; NoSuchColumn or AmbiguousColumn otherwise."""
    found = [n for n in names if n.lower() == pattern.lower()] or [n for n in names if re.match(wildcard(pattern), n)]
    if len(found) != 1:
        raise (AmbiguousColumn if found else NoSuchColumn)(pattern)
    return found[0]
