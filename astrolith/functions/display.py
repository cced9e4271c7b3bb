"""Values rendered by display formats: A, L, I, B, O, Z, F, E, D, ES, EN and G."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import BadTform

_FORMAT = re.compile(r"^(EN|ES|[ALIBOZFEGD])(\d+)(?:\.(\d+))?(?:E(\d+))?$", re.I)


def parse(text: str) -> dict:
    """code, width, decimals (or least digits) and exponent digits of a format."""
    m = _FORMAT.match(text.strip())
    if not m or int(m[2]) == 0:
        raise BadTform(text)
    return {"code": m[1].upper(), "width": int(m[2]), "decimals": int(m[3] or 0), "exponent": int(m[4] or 0)}


def _right(body: Column, width: int) -> Column:
    return F.when(F.length(body) <= width, F.lpad(body, width, " ")).otherwise(F.raise_error(F.lit("BadTform")))


def _fixed(x: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", x)


def decade(x: Column) -> Column:
    """The power of ten of the first digit; 0 for 0.  The logarithm is set right at whole decades."""
    a = F.abs(x)
    e = F.floor(F.log10(a)).cast("int")
    m = a / F.pow(F.lit(10.0), e)
    e = F.when(m >= 10, e + 1).when(m < 1, e - 1).otherwise(e)
    return F.when((a > 0) & (a < F.lit(float("inf"))), e).otherwise(0)


def _scientific(x: Column, decimals: int, digits: int, letter: str, engineering: bool) -> Column:
    e = decade(x)
    if engineering:
        e = e - F.pmod(e, F.lit(3))
    mantissa = F.when(x == 0, x).otherwise(x / F.pow(F.lit(10.0), e))
    power = F.abs(e).cast("string")
    power = F.lpad(power, F.greatest(F.length(power), F.lit(digits or 2)), F.lit("0"))
    return F.concat(_fixed(mantissa, decimals), F.lit(letter), F.when(e < 0, "-").otherwise("+"), power)


def render_real(x: Column, form: str) -> Column:
    """A real number by F, E, D, ES, EN or G; null for null, an error if it is too wide."""
    f = parse(form)
    code, d, digits = f["code"], f["decimals"], f["exponent"]
    if code == "F":
        body = _fixed(x, d)
    elif code == "G":
        e = decade(x)
        body = _scientific(x, max(d - 1, 0), digits, "E", False)
        # With e in [-1, d - 1], d digits in all are written in fixed form.
        for k in range(-1, d):
            body = F.when((x != 0) & (e == k), _fixed(x, max(d - 1 - k, 0))).otherwise(body)
        body = F.when(x == 0, _fixed(x, max(d - 1, 0))).otherwise(body)
    else:
        body = _scientific(x, d, digits, "D" if code == "D" else "E", code == "EN")
    # format_string would write a null as "null".
    return F.when(x.isNotNull(), _right(body, f["width"]))


def render_integer(x: Column, form: str) -> Column:
    """An integer by I, B, O or Z: a sign, then at least as many digits as asked for."""
    f = parse(form)
    magnitude = F.abs(x).cast("bigint")
    body = {"I": magnitude.cast("string"), "B": F.bin(magnitude), "O": F.conv(magnitude.cast("string"), 10, 8), "Z": F.hex(magnitude)}[f["code"]]
    if f["decimals"]:
        body = F.lpad(body, F.greatest(F.length(body), F.lit(f["decimals"])), F.lit("0"))
    return _right(F.concat(F.when(x < 0, "-").otherwise(""), body), f["width"])


def render_text(x: Column, form: str) -> Column:
    """A text by A: cut or padded to the width."""
    return F.rpad(x, parse(form)["width"], " ")


def render_logical(x: Column, form: str) -> Column:
    """T or F at the right of the width."""
    return F.lpad(F.when(x, "T").otherwise("F"), parse(form)["width"], " ")
