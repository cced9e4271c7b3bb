"""Validation rules as queries over the catalog and the cards; findings are their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANDATORY = ("SIMPLE", "XTENSION", "BITPIX", "NAXIS", "PCOUNT", "GCOUNT", "TFIELDS", "END")
BITPIX = (8, 16, 32, 64, -32, -64)


def _finding(rows: DataFrame, when: Column, severity: str, kw, message: str) -> DataFrame:
    keyword = F.lit(kw) if isinstance(kw, str) else kw
    return rows.filter(when).select("hdu", F.lit(severity).alias("severity"), keyword.alias("kw"), F.lit(message).alias("msg"))


def _all(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def image_rules(catalog: DataFrame) -> DataFrame:
    """hdu, severity, kw, msg for images; catalog has bitpix, gcount, pcount, kind and blank (is there a BLANK)."""
    image = F.col("kind").isin("primary", "image")
    return _all(
        _finding(catalog, ~F.col("bitpix").isin(*BITPIX), "err", "BITPIX", "not a value that BITPIX has"),
        _finding(catalog, F.col("blank") & (F.col("bitpix") < 0), "err", "BLANK", "BLANK with real numbers"),
        _finding(catalog, F.col("gcount") <= 0, "err", "GCOUNT", "GCOUNT is not positive"),
        _finding(catalog, image & (F.col("pcount") != 0), "warning", "PCOUNT", "PCOUNT of an image is not 0"),
        _finding(catalog, image & (F.col("gcount") != 1), "warning", "GCOUNT", "GCOUNT of an image is not 1"),
    )


def duplicates(cards: DataFrame) -> DataFrame:
    """hdu, kw, severity, n for keywords that repeat in a header; commentary may."""
    plain = ~F.col("name").isin("COMMENT", "HISTORY", "", "CONTINUE")
    counts = cards.filter(plain).groupBy("hdu", F.col("name").alias("kw")).agg(F.count("*").alias("n")).filter("n > 1")
    mandatory = F.col("kw").isin(*MANDATORY) | F.col("kw").rlike(r"^(NAXIS|TFORM|TBCOL)\d+$")
    return counts.withColumn("severity", F.when(mandatory, "err").otherwise("warning"))


def widths(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """hdu, width, ok: the fields' widths by TFORM, added up, against NAXIS1."""
    from ..sources.schema import tform_columns

    # Formats are counted first, so that each is taken apart once for an HDU.
    counts = fields.groupBy("hdu", "tform").agg(F.count("*").alias("n"))
    total = counts.groupBy("hdu").agg(F.sum(tform_columns(F.col("tform"))["width"] * F.col("n")).alias("width"))
    return total.join(wanted, "hdu").withColumn("ok", F.col("width") == F.col("naxis1"))


def table_rules(catalog: DataFrame, cards: DataFrame) -> DataFrame:
    """Findings for tables: fixed values, TFIELDS, TFORM syntax, row width, scaling of texts and bits."""
    tables = catalog.filter(F.col("kind").isin("binary_table", "ascii_table"))
    binary = F.col("kind") == "binary_table"
    number = F.regexp_extract("name", r"^TFORM(\d+)$", 1).try_cast("int")
    forms = cards.filter(F.col("name").rlike(r"^TFORM\d+$")).select("hdu", number.alias("field"), F.trim("v_str").alias("tform"))
    forms = forms.join(tables.filter(binary).select("hdu"), "hdu", "left_semi")
    from ..sources.schema import tform_columns

    code = tform_columns(F.col("tform"))["code"]
    scaled = cards.filter(F.col("name").rlike(r"^T(SCAL|ZERO)\d+$")).select("hdu", F.regexp_extract("name", r"(\d+)$", 1).try_cast("int").alias("field"), "name")
    wrong = forms.withColumn("code", code).filter(F.col("code").isin("A", "L", "X")).join(scaled, ["hdu", "field"])
    sums = widths(forms.select("hdu", "tform"), tables.filter(binary).select("hdu", F.get("axes", F.lit(0)).alias("naxis1")))
    return _all(
        _finding(tables, F.col("bitpix") != 8, "err", "BITPIX", "BITPIX of a table is not 8"),
        _finding(tables, F.col("naxis") != 2, "err", "NAXIS", "NAXIS of a table is not 2"),
        _finding(tables, F.col("gcount") != 1, "err", "GCOUNT", "GCOUNT of a table is not 1"),
        _finding(tables, ~binary & (F.col("pcount") != 0), "err", "PCOUNT", "PCOUNT of an ASCII table is not 0"),
        _finding(tables, ~F.col("tfields").between(0, 999) | F.col("tfields").isNull(), "err", "TFIELDS", "TFIELDS is not in 0 to 999"),
        _finding(forms, code.isNull(), "err", F.concat(F.lit("TFORM"), F.col("field")), "no binary table format"),
        _finding(sums, ~F.col("ok"), "err", "NAXIS1", "the fields' widths do not add up to NAXIS1"),
        _finding(wrong, F.lit(True), "warning", F.col("name"), "a text, logical or bit field is scaled"),
    )


def order_rules(catalog: DataFrame, cards: DataFrame) -> DataFrame:
    """Findings about mandatory keywords that are missing or out of their places."""
    tables = F.col("kind").isin("binary_table", "ascii_table")
    first = F.when(F.col("hdu") == 1, "SIMPLE").otherwise("XTENSION")
    axes = F.when(F.col("naxis") > 0, F.transform(F.sequence(F.lit(1), F.col("naxis")), lambda i: F.concat(F.lit("NAXIS"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    rest = F.when(tables, F.array(F.lit("PCOUNT"), F.lit("GCOUNT"), F.lit("TFIELDS"))).otherwise(F.array().cast("array<string>"))
    wanted = catalog.select("hdu", F.posexplode(F.concat(F.array(first, F.lit("BITPIX"), F.lit("NAXIS")), axes, rest)).alias("place", "name"))
    seen = cards.filter("kind = 'value'").groupBy("hdu", "name").agg(F.min("idx").alias("idx"))
    found = wanted.join(seen, ["hdu", "name"], "left")
    return _all(
        _finding(found, F.col("idx").isNull(), "err", F.col("name"), "a mandatory keyword is missing"),
        _finding(found, F.col("idx") != F.col("place"), "err", F.col("name"), "a mandatory keyword is out of its place"),
    )


def ascii_rules(catalog: DataFrame, cards: DataFrame) -> DataFrame:
    """Findings about fields of ASCII tables that reach beyond the row or have no format."""
    tables = catalog.filter("kind = 'ascii_table'").select("hdu", F.get("axes", F.lit(0)).alias("naxis1"))
    number = lambda name: F.regexp_extract("name", rf"^{name}(\d+)$", 1).try_cast("int")
    begins = cards.filter(F.col("name").rlike(r"^TBCOL\d+$")).select("hdu", number("TBCOL").alias("field"), F.col("v_int").alias("at"))
    forms = cards.filter(F.col("name").rlike(r"^TFORM\d+$")).select("hdu", number("TFORM").alias("field"), F.trim("v_str").alias("form"))
    width = F.regexp_extract("form", r"^[AIFED](\d+)(?:\.\d+)?$", 1).try_cast("bigint")
    rows = tables.join(forms, "hdu").join(begins, ["hdu", "field"], "left").withColumn("width", width)
    return _all(
        _finding(rows, F.col("width").isNull(), "err", F.concat(F.lit("TFORM"), F.col("field")), "no ASCII table format"),
        _finding(rows, F.col("at").isNull() | (F.col("at") < 1) | (F.col("at") - 1 + F.col("width") > F.col("naxis1")), "err", F.concat(F.lit("TBCOL"), F.col("field")), "the field is not inside the row"),
    )


def verify(catalog: DataFrame, cards: DataFrame) -> DataFrame:
    """All findings over a file's catalog and cards, by HDU."""
    seen = duplicates(cards).select("hdu", "severity", "kw", F.lit("the keyword repeats").alias("msg"))
    blank = cards.filter("name = 'BLANK'").select("hdu", F.lit(True).alias("blank")).distinct()
    rows = catalog.join(blank, "hdu", "left").withColumn("blank", F.coalesce("blank", F.lit(False)))
    sums = _finding(rows, F.col("datasum_status") == "mismatch", "err", "DATASUM", "the data do not add up to DATASUM") if "datasum_status" in rows.columns else None
    whole = _finding(rows, F.col("checksum_status") == "mismatch", "err", "CHECKSUM", "the HDU does not add up to all ones") if "checksum_status" in rows.columns else None
    beyond = _finding(rows, F.col("truncated"), "err", "NAXIS", "the data unit reaches beyond the file") if "truncated" in rows.columns else None
    odd = [_finding(rows, F.col(c) == "unreadable", "warning", k, f"{k} cannot be read") for c, k in (("datasum_status", "DATASUM"), ("checksum_status", "CHECKSUM")) if c in rows.columns]
    cut = [_finding(rows.join(cards.filter("name in ('DATASUM', 'CHECKSUM')").select("hdu").distinct(), "hdu", "left_semi"), F.col("truncated"), "warning", "DATASUM", "the sums of a truncated data unit cannot be checked")] if beyond is not None else []
    found = [image_rules(rows), table_rules(rows, cards), order_rules(rows, cards), ascii_rules(rows, cards), seen, *[x for x in (sums, whole, beyond) if x is not None], *odd, *cut]
    return _all(*found).orderBy("hdu", "kw", "severity")
