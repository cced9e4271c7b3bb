"""Column expressions against values that are fixed by the standard or worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from astrolith import errors
from astrolith.functions import arrays, cards, checksum, convert, display, sky, text, times


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "kind", "outcome"), [(2.5, "i8", 3), (-2.5, "i8", -3), (128.0, "i8", "Overflow"), (float("nan"), "i32", "NanToInt"), (9.3e18, "i64", "Overflow"), (2.0**63, "i64", "Overflow"), (-(2.0**63), "i64", -(1 << 63))])
def test_integers(spark, value, kind, outcome):
    if isinstance(outcome, str):
        assert one(spark, convert.cast_class(F.lit(value), kind)) == outcome
        assert one(spark, convert.to_integer(F.lit(value), kind, on_error="null")) is None
        with pytest.raises(Exception, match=outcome):
            one(spark, convert.to_integer(F.lit(value), kind))
    else:
        assert one(spark, convert.to_integer(F.lit(value), kind)) == outcome


def test_exactness(spark):
    assert not one(spark, convert.exact_as_double(F.lit((1 << 53) + 1)))
    assert one(spark, convert.exact_as_double(F.lit(1 << 62)))
    assert not one(spark, convert.exact_as_double(F.lit((1 << 63) - 1)))


@pytest.mark.parametrize(("field", "decimals", "value"), [("3.1416", 0, 3.1416), ("31416", 4, 3.1416), ("3.14D2", 0, 314.0), ("3.14-2", 0, 0.0314), ("-12", 1, -1.2), (".5E+1", 0, 5.0), ("1 2", 0, None), ("", 0, None), (".", 0, None), ("1e400", 0, None), ("1_0", 0, None)])
def test_real_fields(spark, field, decimals, value):
    assert one(spark, text.parse_real(F.lit(field), decimals)) == (None if value is None else pytest.approx(value, rel=1e-15))


def test_wildcards():
    names = ["FLUX", "FLUX_ERR", "X1", "X22", "a.b"]
    assert text.resolve(names, "flux") == "FLUX"
    with pytest.raises(errors.AmbiguousColumn):
        text.resolve(names, "FLUX*")
    with pytest.raises(errors.NoSuchColumn):
        text.resolve(names, "axb")
    with pytest.raises(errors.AmbiguousColumn):
        text.resolve(names, "X#")


def test_cards(spark):
    raw = cards.build(F.lit("OBJECT"), cards.quote(F.lit("O'Neil")), F.lit("[km] who"))
    assert one(spark, raw).startswith("OBJECT  = 'O''Neil '") and len(one(spark, raw)) == 80
    assert one(spark, cards.string_value(cards.value_field(raw))) == "O'Neil"
    assert one(spark, cards.unit(cards.comment(cards.value_field(raw)))) == "km"
    assert one(spark, cards.string_value(F.lit("'   '"))) == " "
    assert one(spark, cards.string_value(F.lit("''"))) == ""
    for field, kind in (("                   T", "logical"), ("  12 / x", "int"), (" 1.5D3", "float"), ("(1.0, 2.0)", "complex"), ("  / no value", "undefined"), ("99999999999999999999", "float")):
        assert one(spark, cards.value_type(F.lit(field))) == kind
    with pytest.raises(Exception, match="CardOverflow"):
        one(spark, cards.build(F.lit("A"), F.lit("x" * 80)))


def test_checksums(spark):
    # The coded forms of zero and of all ones are fixed by the algorithm.
    assert checksum.encode_number(0) == "0" * 16
    for value in (0, 1, 0xFFFFFFFF, 1837006711, 0x12345678, 0x3A5B403F):
        coded = checksum.encode_number(value)
        assert coded.isalnum() and checksum.decode_text(coded) == value
        assert one(spark, checksum.encode(F.lit(value))) == coded
    words = [0xFFFFFFFF, 0x00010001, 0x80000000, 0x80000000]
    want = 0
    for w in words:
        want += w
        want = (want & 0xFFFFFFFF) + (want >> 32)
    got = spark.createDataFrame([(w,) for w in words], "w bigint").agg(checksum.sum_words(F.col("w")).alias("s")).first()["s"]
    assert got == want == checksum.words_of(b"".join(w.to_bytes(4, "big") for w in words))


#: Pixels and sky positions of a TAN image: reference pixel (32, 32) at (150, 2.5), steps of 6e-4 degrees.
REFERENCE = [(32, 32, 150.0, 2.5), (1, 1, 150.0186174554, 2.4813998698), (11, 51, 150.0126121132, 2.5113999391), (64, 64, 149.9807814280, 2.5191998577), (21.5, 41.25, 150.0063060286, 2.5055499848)]


def test_tan_reference(spark):
    w = sky.Celestial((32.0, 32.0), (150.0, 2.5), sky.matrix((-6e-4, 6e-4)), "TAN")
    for p1, p2, ra, dec in REFERENCE:
        a, d = sky.pixel_to_world(F.lit(float(p1)), F.lit(float(p2)), w)
        assert one(spark, a) == pytest.approx(ra, abs=1e-6) and one(spark, d) == pytest.approx(dec, abs=1e-6)
        x, y = sky.world_to_pixel(F.lit(ra), F.lit(dec), w)
        assert one(spark, x) == pytest.approx(p1, abs=1e-5) and one(spark, y) == pytest.approx(p2, abs=1e-5)


def test_bad_wcs():
    with pytest.raises(errors.BadWcs):
        sky.matrix(pc=[[1, 0], [0, 1]], cd=[[1, 0], [0, 1]])
    with pytest.raises(errors.UnsupportedProjection):
        sky.Celestial((0, 0), (0, 0), sky.matrix(), "AIT")
    with pytest.raises(errors.NonInvertible):
        sky.Celestial((0, 0), (0, 0), [[0, 0], [0, 0]]).inverse()


def test_times(spark):
    jd = times.julian_date(times.parse(F.lit("2000-01-01T12:00:00")))
    assert one(spark, jd) == 2451545.0
    back = one(spark, times.date_of(F.lit(2451545.0)))
    assert (back["year"], back["month"], back["day"], back["hour"]) == (2000, 1, 1, 12)
    assert one(spark, times.parse(F.lit("31/12/98")))["year"] == 1998
    assert one(spark, times.parse(F.lit("2016-12-31T23:59:60")))["second"] == 60
    for wrong in ("2001-02-29", "2001-13-01", "2001-01-01T24:00:00", "x", "01/13/98"):
        assert one(spark, times.parse(F.lit(wrong))) is None
    assert one(spark, times.format_date(times.parse(F.lit("+12345-06-07T01:02:03.25")))) == "+12345-06-07T01:02:03.250"
    assert one(spark, times.julian_epoch(F.lit(2451545.0))) == 2000.0
    assert one(spark, times.besselian_epoch(F.lit(2415020.31352))) == 1900.0


@pytest.mark.parametrize(("value", "form", "shown"), [(3.14159, "F8.3", "   3.142"), (1234.5, "E12.4", "  1.2345E+03"), (0.00125, "D10.2", "  1.25D-03"), (12345.0, "EN12.3", "  12.345E+03"), (0.5, "G8.3", "   0.500"), (1e10, "G10.3", "  1.00E+10"), (1000.0, "ES9.2E3", "1.00E+003"), (0.0, "E10.2", "  0.00E+00")])
def test_display(spark, value, form, shown):
    assert one(spark, display.render_real(F.lit(value), form)) == shown


@pytest.mark.parametrize("form", ["F12.3", "F2.0", "E16.6", "D16.6", "ES18.8E3", "EN16.6", "EN4.0", "G14.7"])
def test_display_null(spark, form):
    # Also in a width that the word null would fill or not fit.
    assert one(spark, display.render_real(F.lit(None).cast("double"), form)) is None


@pytest.mark.parametrize(("value", "shown"), [(0.5, "  500.000000E-03"), (-0.07, "  -70.000000E-03"), (0.0005, "  500.000000E-06"), (0.0, "    0.000000E+00"), (1.0, "    1.000000E+00"), (-999.99, " -999.990000E+00"), (1000.0, "    1.000000E+03")])
def test_display_engineering(spark, value, shown):
    """An exponent has one sign and at least two digits, which the SQL of tdisp_en, without abs, does not give below 1."""
    assert one(spark, display.render_real(F.lit(value), "EN16.6")) == shown


def test_display_integers(spark):
    assert one(spark, display.render_integer(F.lit(-255), "Z8.4")) == "   -00FF"
    assert one(spark, display.render_integer(F.lit(8), "O4")) == "  10"
    with pytest.raises(Exception, match="BadTform"):
        one(spark, display.render_integer(F.lit(123456), "I3"))
    with pytest.raises(errors.BadTform):
        display.parse("Q5")


def test_sections():
    assert arrays.section_counts([0, 1], [4, 3], [2, 2]) == [3, 2]
    with pytest.raises(errors.BadDimensions):
        arrays.section_counts([3], [1], [1])


def test_ramp_section(spark):
    rows = spark.range(36).select(F.col("id").alias("pix"), F.col("id").alias("value"))
    got = arrays.section(rows, "pix", [6, 6], [0, 1], [4, 3], [2, 2]).orderBy("pix")
    assert [r["value"] for r in got.collect()] == [6, 8, 10, 18, 20, 22]
    assert math.prod(arrays.section_counts([0, 1], [4, 3], [2, 2])) == 6


def test_reference_frames(spark):
    rows = spark.createDataFrame([(" barycent",), ("LSRK",), ("MOON",), (None,), ("",)], "s string").select(sky.frame(F.col("s")).alias("f"))
    assert [r["f"] for r in rows.collect()] == ["BARYCENT", "LSRK", "unknown", "unknown", "unknown"]


def test_members_that_are_there(spark):
    from astrolith.operators import grouping

    kinds = "rownum int, location string, position int, name string, version int"
    rows = spark.createDataFrame([(0, "", 2, None, None), (1, None, 9, "sci", None), (2, "http://x", 2, "SCI", 1), (3, "", None, "SCI", 2), (4, " ", 0, "gone", 1)], kinds)
    catalog = spark.createDataFrame([(1, None, 1), (2, "ERR", 1), (3, "SCI ", None), (4, "SCI", 2)], "hdu int, extname string, extver int")
    assert {r["rownum"]: r["hdu"] for r in grouping.members(rows, catalog).collect()} == {0: 2, 1: 3, 3: 4}
    assert grouping.resolve(rows, catalog).count() == 5
