"""Formats of table columns and the Spark types they read as."""

from __future__ import annotations

import dataclasses
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadDimensions, BadTbcol, BadTdim, BadTform

#: Fixed values of the format: bytes of an element, by code.
WIDTHS = {"L": 1, "X": 1, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}
#: On disk, as numpy types.
NUMPY = {"L": "u1", "X": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "A": "u1", "E": ">f4", "D": ">f8", "C": ">f4", "M": ">f8", "P": ">i4", "Q": ">i8"}
#: Whole numbers with a whole zero point read as decimals of so many digits.
WHOLE_DIGITS = 38
_BINARY = re.compile(r"^(\d*)([LXBIJKAEDCMPQ])(.*)$")
_ASCII = re.compile(r"^([AIFED])(\d+)(?:\.(\d+))?$")


def tform_columns(form: Column) -> dict[str, Column]:
    """repeat, code and width in bytes of binary formats; null where the format is none."""
    pattern = r"^(\d*)([LXBIJKAEDCMPQ])(.*)$"
    form = F.trim(form)
    good = form.rlike(r"^\d*[LXBIJKAED CM]$|^\d*A\d*$|^[01]?[PQ]([LXBIJKAEDCM](\(\d*\))?)?$".replace(" ", ""))
    digits = F.regexp_extract(form, pattern, 1)
    repeat = F.when(digits == "", F.lit(1).cast("bigint")).otherwise(digits.try_cast("bigint"))
    good = good & repeat.isNotNull()
    code = F.regexp_extract(form, pattern, 2)
    size = F.lit(0)
    for k, w in WIDTHS.items():
        size = F.when(code == k, w).otherwise(size)
    width = F.when(code == "X", F.ceil(repeat / 8)).when(code.isin("P", "Q"), size).otherwise(repeat * size)
    return {"repeat": F.when(good, repeat), "code": F.when(good, code), "width": F.when(good, width.cast("bigint"))}


@dataclasses.dataclass
class Field:
    """A column of a binary or ASCII table as its header describes it."""

    name: str
    code: str
    repeat: int
    offset: int
    width: int
    element: str | None = None  # of a variable-length array
    decimals: int = 0
    scale: float = 1.0
    zero: float = 0.0
    null: object = None
    dims: tuple[int, ...] = ()
    unit: str | None = None
    display: str | None = None

    @property
    def scaled(self) -> bool:
        """Whether values are real numbers after scaling; the unsigned conventions are not."""
        return (self.scale != 1.0 or self.zero != 0.0) and self.unsigned is None

    @property
    def unsigned(self) -> str | None:
        code = self.element or self.code
        own = {("I", float(1 << 15)): "u16", ("J", float(1 << 31)): "u32", ("K", float(1 << 63)): "u64", ("B", -128.0): "i8"}
        return own.get((code, self.zero)) if self.scale == 1.0 else None

    @property
    def whole_zero(self) -> int | None:
        """The zero point of 64-bit integers that are moved by a whole number: doubles would round them."""
        code = self.element or self.code
        if code == "K" and self.scale == 1.0 and self.zero and float(self.zero).is_integer() and abs(self.zero) < 1e30 and not self.unsigned:
            return int(self.zero)
        return None

    def element_type(self) -> T.DataType:
        code = self.element or self.code
        if self.whole_zero is not None:
            return T.DecimalType(WHOLE_DIGITS, 0)
        if self.unsigned:
            return {"u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "i8": T.ByteType()}[self.unsigned]
        if self.scaled and code in "BIJKED":
            return T.DoubleType()
        pair = lambda t: T.StructType([T.StructField("re", t), T.StructField("im", t)])
        return {
            "L": T.BooleanType(), "X": T.BooleanType(), "B": T.ShortType(), "I": T.ShortType(), "J": T.IntegerType(), "K": T.LongType(), "A": T.StringType(),
            "E": T.FloatType(), "D": T.DoubleType(), "C": pair(T.FloatType()), "M": pair(T.DoubleType()),
        }[code]

    def spark_type(self) -> T.DataType:
        own = self.element_type()
        if self.element:
            return own if self.element == "A" else T.ArrayType(own)
        if self.code == "A":
            return T.ArrayType(own) if len(self.dims) > 1 else own
        if self.dims and len(self.dims) > 1:
            for _ in self.dims:
                own = T.ArrayType(own)
            return own
        return own if self.repeat == 1 else T.ArrayType(own)

    def spark_field(self) -> T.StructField:
        about = {"code": self.code, "repeat": self.repeat, "scale": self.scale, "zero": self.zero}
        about |= {k: v for k, v in {"unit": self.unit, "display": self.display, "null": self.null if isinstance(self.null, int) else None}.items() if v is not None}
        return T.StructField(self.name, self.spark_type(), True, about)


def parse_binary(form: str) -> tuple[str, int, str | None]:
    """(code, repeat, element of a variable-length array) of a binary format."""
    m = _BINARY.match(form.strip())
    if not m or len(m[1]) > 15:
        raise BadTform(form)
    code, repeat, rest = m[2], int(m[1] or 1), m[3]
    if code in "PQ":
        n = re.match(r"^([LXBIJKAEDCM])(?:\(\d*\))?$", rest)
        if not n or repeat > 1:
            raise BadTform(form)
        return code, repeat, n[1]
    if rest and not (code == "A" and rest.isdigit()):
        raise BadTform(form)
    return code, repeat, None


def parse_ascii(form: str) -> tuple[str, int, int]:
    """(code, width, decimals) of an ASCII format."""
    m = _ASCII.match(form.strip())
    if not m or int(m[2]) == 0:
        raise BadTform(form)
    return m[1], int(m[2]), int(m[3] or 0)


def parse_dims(text: str | None, repeat: int, variable: bool = False) -> tuple[int, ...]:
    """The axes of TDIM, the first varying fastest."""
    if not text or not text.strip():
        return ()
    m = re.match(r"^\(\s*\d+(\s*,\s*\d+)*\s*\)$", text.strip())
    if not m:
        raise BadTdim(text)
    dims = tuple(int(x) for x in re.findall(r"\d+", text))
    if not variable and int(np.prod(dims)) > repeat:
        raise BadTdim(text)
    return dims


def width_of(code: str, repeat: int) -> int:
    """The bytes of a field in a row."""
    if code == "X":
        return -(-repeat // 8)
    return WIDTHS[code] * (repeat if code not in "PQ" else min(repeat, 1))


def whole_or_real(header, name: str) -> float:
    """A zero point: an int as it is written, which may be more exact than a double, else a double."""
    real, v = header.real(name, 0.0), header.value(name)
    return v if isinstance(v, int) else real


def fields_of(header) -> list[Field]:
    """The fields of a table's header."""
    count, binary = header.integer("TFIELDS"), header.text("XTENSION") in ("BINTABLE", "A3DTABLE")
    out, offset = [], 0
    for i in range(1, count + 1):
        form = header.text(f"TFORM{i}")
        name = header.text(f"TTYPE{i}") or f"col{i}"
        extra = {"scale": header.real(f"TSCAL{i}", 1.0), "zero": whole_or_real(header, f"TZERO{i}"), "unit": header.text(f"TUNIT{i}"), "display": header.text(f"TDISP{i}")}
        if binary:
            code, repeat, element = parse_binary(form)
            dims = parse_dims(header.text(f"TDIM{i}"), repeat, element is not None)
            width = width_of(code, repeat)
            out.append(Field(name, code, repeat, offset, width, element, null=header.value(f"TNULL{i}"), dims=dims, **extra))
            offset += width
        else:
            code, width, decimals = parse_ascii(form)
            at = header.integer(f"TBCOL{i}") - 1
            if at < 0 or at + width > header.integer("NAXIS1"):
                raise BadTbcol(f"TBCOL{i}")
            out.append(Field(name, code, 1, at, width, decimals=decimals, null=header.text(f"TNULL{i}"), **extra))
    if binary and offset != header.integer("NAXIS1"):
        raise BadDimensions("the fields' widths do not add up to NAXIS1")
    seen: dict[str, int] = {}
    for f in out:  # Spark needs distinct names
        k = f.name.lower()
        seen[k] = seen.get(k, 0) + 1
        if seen[k] > 1:
            f.name = f"{f.name}_{seen[k]}"
    return out
