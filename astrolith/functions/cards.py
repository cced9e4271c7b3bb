"""Header cards of 80 characters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STRING = r"^ *'((?:[^']|'')*)'"
_COMMENT = r"^ *(?:'(?:[^']|'')*'|[^/']*) */ ?(.*)$"


def name(card: Column) -> Column:
    """The keyword: the first eight characters, upper case, without trailing blanks."""
    return F.upper(F.rtrim(F.substring(card, 1, 8)))


def kind(card: Column) -> Column:
    """end, continue, blank, commentary, hierarch or value."""
    k = name(card)
    return (
        F.when(k == "END", "end").when(k == "CONTINUE", "continue").when(k == "", "blank").when(k.isin("COMMENT", "HISTORY"), "commentary")
        .when((k == "HIERARCH") & (F.instr(card, "=") > 0), "hierarch").when(F.substring(card, 9, 2) == "= ", "value").otherwise("commentary")
    )


def value_field(card: Column) -> Column:
    """Characters 11 to 80."""
    return F.substring(card, 11, 70)


def string_value(text: Column) -> Column:
    """A quoted text: doubled quotes are one, trailing blanks go, all blanks are one blank; else null."""
    inner = F.replace(F.regexp_extract(text, _STRING, 1), F.lit("''"), F.lit("'"))
    cut = F.rtrim(inner)
    return F.when(text.rlike(_STRING), F.when((inner != "") & (cut == ""), " ").otherwise(cut))


def token(text: Column) -> Column:
    """What stands before the comment of a value that is no text, without blanks around it."""
    return F.trim(F.regexp_extract(text, r"^([^/]*)", 1))


def value_type(text: Column) -> Column:
    """string, logical, complex, int, float or undefined."""
    t = token(text)
    return (
        F.when(F.ltrim(text).startswith("'"), "string").when(t == "", "undefined").when(t.isin("T", "F"), "logical").when(t.startswith("("), "complex")
        .when(t.rlike(r"^[+-]?\d+$") & t.try_cast("bigint").isNotNull(), "int").when(real_value(t).isNotNull(), "float").otherwise("invalid")
    )


def integer_value(text: Column) -> Column:
    """The integer, or null."""
    t = token(text)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))


def real_value(text: Column) -> Column:
    """The real number of digits, signs, point and E or D; null if none or not finite."""
    t = token(text)
    x = F.translate(t, "Dd", "Ee").try_cast("double")
    return F.when(t.rlike(r"^[0-9+\-.EeDd]+$") & (F.abs(x) < F.lit(float("inf"))), x)


def logical_value(text: Column) -> Column:
    """true for T, false for F, else null."""
    return F.when(token(text) == "T", True).when(token(text) == "F", False)


def complex_value(text: Column) -> Column:
    """(re, im) as a struct of doubles, or null."""
    part = lambda n: F.translate(F.regexp_extract(token(text), r"^\( *([^, ]+) *, *([^) ]+) *\)$", n), "Dd", "Ee").try_cast("double")
    return F.when(part(1).isNotNull() & part(2).isNotNull(), F.struct(part(1).alias("re"), part(2).alias("im")))


def comment(text: Column) -> Column:
    """What follows the slash outside of quotes, without trailing blanks; null if there is none."""
    return F.when(text.rlike(_COMMENT), F.rtrim(F.regexp_extract(text, _COMMENT, 1)))


def unit(comment_text: Column) -> Column:
    """The unit in brackets at the beginning of a comment, or null."""
    found = F.regexp_extract(comment_text, r"^\[([^\]]*)\]", 1)
    return F.when(comment_text.rlike(r"^\[[^\]]*\]"), found)


def quote(text: Column) -> Column:
    """The quoted form: quotes doubled, padded to eight characters inside."""
    inner = F.replace(text, F.lit("'"), F.lit("''"))
    return F.concat(F.lit("'"), F.when(F.length(inner) < 8, F.rpad(inner, 8, " ")).otherwise(inner), F.lit("'"))


def format_integer(x: Column) -> Column:
    """Right-justified to 20 characters."""
    return F.lpad(x.cast("string"), 20, " ")


def format_logical(x: Column) -> Column:
    """T or F, right-justified to 20 characters."""
    return F.lpad(F.when(x, "T").otherwise("F"), 20, " ")


def build(keyword: Column, value: Column, remark: Column | None = None) -> Column:
    """A card of 80 characters; an error if it does not fit."""
    text = F.concat(F.rpad(keyword, 8, " "), F.lit("= "), value)
    if remark is not None:
        text = F.concat(text, F.coalesce(F.concat(F.lit(" / "), remark), F.lit("")))
    return F.when(F.length(text) <= 80, F.rpad(text, 80, " ")).otherwise(F.raise_error(F.lit("CardOverflow")))


def hierarch_name(card: Column) -> Column:
    """What stands between HIERARCH and the first equals sign, runs of blanks as one."""
    return F.trim(F.regexp_replace(F.regexp_extract(card, r"(?i)^HIERARCH ([^=]*)=", 1), " +", " "))


def same_hierarch(a: Column, b: Column) -> Column:
    """Whether two names are the same words, without regard to case or to a HIERARCH before them."""
    plain = lambda c: F.upper(F.regexp_replace(F.trim(F.regexp_replace(c, " +", " ")), "(?i)^HIERARCH ", ""))
    return plain(a) == plain(b)


def split_long(text: Column, width: int = 67) -> Column:
    """The pieces of a long text for CONTINUE cards: all but the last end in an ampersand."""
    # One pass over the text: a piece is the longest run of characters that still fits.
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))

    def marked(p: Column) -> Column:
        most = F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x: F.concat(x, F.lit("&")))
        return F.when(F.size(p) == 0, F.array(F.lit(""))).otherwise(F.concat(most, F.slice(p, F.greatest(F.size(p), F.lit(1)), F.lit(1))))

    # Bound to a variable, so that the pieces are made once and not again for each of them.
    return F.transform(F.array(pieces), marked)[0]


def assemble(cards: DataFrame, by: list[str], order: str, base: str, text: str) -> DataFrame:
    """Texts that CONTINUE cards go on with, put together.

    base is true on a card that begins a text.  The next card goes on with it if base is false there
    and the text so far ends in an ampersand, which is taken off; else the ampersand is a character
    of the text, and cards that go on with nothing are left out.  by names what cards are grouped by,
    such as a file's HDU, which also bounds what is gathered.
    """
    w = Window.partitionBy(*by).orderBy(order)
    begins = F.col(base) | ~F.coalesce(F.lag(text).over(w).endswith("&"), F.lit(False))
    rows = cards.withColumn("_begins", begins)
    rows = rows.withColumn("_group", F.sum(F.col("_begins").cast("int")).over(w)).withColumn("_more", F.coalesce(~F.lead("_begins").over(w), F.lit(False)))
    piece = F.when(F.col("_more"), F.regexp_replace(text, "&$", "")).otherwise(F.col(text))
    parts = rows.groupBy(*by, "_group").agg(F.min_by(base, order).alias("_own"), F.min(order).alias(order), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("t")))).alias("_parts")).filter("_own")
    return parts.select(*by, order, F.array_join(F.transform("_parts", lambda p: p["t"]), "").alias(text))


#: Keywords that describe a data unit itself and are never inherited.
STRUCTURAL = ("SIMPLE", "XTENSION", "BITPIX", "NAXIS", "EXTEND", "PCOUNT", "GCOUNT", "TFIELDS", "THEAP", "GROUPS", "EXTNAME", "EXTVER", "EXTLEVEL", "INHERIT", "CHECKSUM", "DATASUM", "BSCALE", "BZERO", "BLANK", "END")


def inheritable(keyword: Column) -> Column:
    """Whether a keyword of the primary header may stand in for one that an extension lacks."""
    return ~(keyword.isin(*STRUCTURAL) | keyword.rlike(r"^(NAXIS|TFORM|TTYPE|TUNIT|TSCAL|TZERO|TNULL|TDISP|TDIM|TBCOL|PTYPE|PSCAL|PZERO)\d+$"))


def inherit(own: DataFrame, primary: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hdu, name, value): each wanted keyword from the HDU's own header, else from the primary's.

    own has hdu, name and value, primary name and value, wanted hdu and name.
    """
    rows = wanted.join(own, ["hdu", "name"], "left")
    base = primary.filter(inheritable(F.col("name"))).select("name", F.col("value").alias("_base"))
    return rows.join(base, "name", "left").select("hdu", "name", F.coalesce("value", "_base").alias("value"))


def first_of(cards: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The value of the first card of each keyword."""
    return cards.groupBy(*by).agg(F.min_by(value, order).alias(value))
