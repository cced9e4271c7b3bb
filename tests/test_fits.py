"""FITS files written by hand, or by this library, and read back."""

import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolith import api, errors
from astrolith.sources import codecs, filespec, hcompress
from astrolith.sources.fits import ascii_integer, ascii_real, open_file, size_of
from astrolith.sources.fits_sink import block, card
from astrolith.sources.header import Card, Header, scan
from astrolith.sources.schema import parse_ascii, parse_binary, parse_dims

PRIMARY = block([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)])


def padded(data: bytes, fill: bytes = b"\0") -> bytes:
    return data + fill * (-len(data) % 2880)


def write(path, *parts: bytes) -> str:
    path.write_bytes(b"".join(parts))
    return str(path)


@pytest.fixture
def session(spark):
    from astrolith.session import prepare

    return prepare(spark)


@pytest.fixture
def monster(tmp_path):
    """A binary table with a column of every type."""
    names = [("LOGIC", "1L"), ("BITS", "8X"), ("UINT8", "1B"), ("INT16", "1I"), ("INT32", "1J"), ("INT64", "1K"), ("FLT32", "1E"), ("FLT64", "1D"), ("CPLX64", "1C"), ("STR", "8A"), ("GRID", "4J"), ("VLAP", "1PJ"), ("VLAQ", "1QJ"), ("U16", "1I")]
    rows, heap = [], b""
    vla = [([10, 20, 30], [7]), ([40], [8, 9]), ([50, 60], [])]
    for i in range(3):
        row = [b"TFT"[i : i + 1], bytes([0b10100000 + i]), bytes([i + 1]), struct.pack(">hiq", (i - 1) * 100, (i - 1) * 100000, (i - 1) << 40), struct.pack(">fd", (1.5, -2.5, 3.5)[i], (1.25, -2.25, 3.25)[i])]
        row += [struct.pack(">ff", 2 * i + 1, 2 * i + 2), (b"alpha", b"beta\0xy", b"\0")[i].ljust(8, b"\0"), struct.pack(">4i", *range(4 * i + 1, 4 * i + 5))]
        p, q = vla[i]
        row.append(struct.pack(">ii", len(p), len(heap)))
        heap += struct.pack(f">{len(p)}i", *p)
        row.append(struct.pack(">qq", len(q), len(heap) if q else 0))
        heap += struct.pack(f">{len(q)}i", *q)
        rows.append(b"".join([*row, struct.pack(">h", -32768 + i)]))
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", len(rows[0])), ("NAXIS2", 3), ("PCOUNT", len(heap)), ("GCOUNT", 1), ("TFIELDS", len(names))]
    for i, (n, f) in enumerate(names, 1):
        head += [(f"TTYPE{i}", n), (f"TFORM{i}", f)]
    head += [("TDIM11", "(2,2)"), ("TZERO14", 32768), ("TNULL4", 0), ("EXTNAME", "MONSTER")]
    return write(tmp_path / "m.fits", PRIMARY, block(head), padded(b"".join(rows) + heap))


def test_every_type(session, monster):
    rows = api.table(monster).orderBy("rownum").collect()
    assert [r["LOGIC"] for r in rows] == [True, False, True]
    assert rows[1]["BITS"] == [True, False, True, False, False, False, False, True]
    assert [r["UINT8"] for r in rows] == [1, 2, 3]
    assert [r["INT16"] for r in rows] == [-100, None, 100]
    assert [r["INT64"] for r in rows] == [-(1 << 40), 0, 1 << 40]
    assert [r["FLT64"] for r in rows] == [1.25, -2.25, 3.25]
    assert [tuple(r["CPLX64"]) for r in rows] == [(1, 2), (3, 4), (5, 6)]
    assert [r["STR"] for r in rows] == ["alpha", "beta", None]
    assert rows[2]["GRID"] == [[9, 10], [11, 12]]
    assert [r["VLAP"] for r in rows] == [[10, 20, 30], [40], [50, 60]]
    assert [r["VLAQ"] for r in rows] == [[7], [8, 9], []]
    assert [r["U16"] for r in rows] == [0, 1, 2]


def test_pruning_and_pushdown(session, monster):
    found = api.table(monster, columns="int*,str").filter("rownum >= 1")
    assert found.columns == ["rownum", "INT16", "INT32", "INT64", "STR"] and found.count() == 2
    assert api.table(monster, rows="1:1").count() == 1
    with pytest.raises(Exception, match="RowOutOfRange"):
        api.table(monster, rows="2:3").count()
    with pytest.raises(Exception, match="NoSuchColumn"):
        api.table(monster, columns="nope").count()


def test_ascii_table(session, tmp_path):
    head = [("XTENSION", "TABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 26), ("NAXIS2", 4), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 2), ("TTYPE1", "COUNT"), ("TBCOL1", 1), ("TFORM1", "I10"), ("TTYPE2", "VALUE"), ("TBCOL2", 12), ("TFORM2", "E15.7"), ("TNULL1", "***")]
    data = b"".join(f"{c:>10} {v:>15}".encode() for c, v in ((1, "5.0000000E-01"), ("***", "-1.2500000E+00"), (333, "1.0000000D+02"), (4444, "")))
    path = write(tmp_path / "a.fits", PRIMARY, block(head), padded(data, b" "))
    rows = api.table(path).orderBy("rownum").collect()
    assert [tuple(r)[1:] for r in rows] == [(1, 0.5), (None, -1.25), (333, 100.0), (4444, None)]


@pytest.mark.parametrize("bitpix", [8, 16, 32, 64, -32, -64])
def test_images(session, tmp_path, bitpix):
    kind = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[bitpix]
    data = np.arange(36).astype(kind)
    path = write(tmp_path / "i.fits", block([("SIMPLE", True), ("BITPIX", bitpix), ("NAXIS", 2), ("NAXIS1", 6), ("NAXIS2", 6)]), padded(data.tobytes()))
    assert [r["value"] for r in api.image(path).orderBy("pix").collect()] == list(range(36))
    cut = api.getdata(f"{path}[1:5:2,2:4:2]").orderBy("pix").collect()
    assert [r["value"] for r in cut] == [6, 8, 10, 18, 20, 22] and [r["pix"] for r in cut] == list(range(6))


def test_scaling_and_blank(session, tmp_path):
    data = np.array([0, 1, 50, -32768], ">i2")
    head = block([("SIMPLE", True), ("BITPIX", 16), ("NAXIS", 1), ("NAXIS1", 4), ("BSCALE", 2.0), ("BZERO", 100.0), ("BLANK", -32768)])
    path = write(tmp_path / "s.fits", head, padded(data.tobytes()))
    assert [r["value"] for r in api.image(path).orderBy("pix").collect()] == [100.0, 102.0, 200.0, None]
    assert [r["value"] for r in api.image(path, raw="true").select(F.col("value").cast("int")).collect()][-1] == -32768


def test_random_groups(session, tmp_path):
    head = block([("SIMPLE", True), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", 0), ("NAXIS2", 3), ("GROUPS", True), ("PCOUNT", 2), ("GCOUNT", 2), ("PSCAL1", 2.0), ("PZERO2", 5.0)])
    path = write(tmp_path / "g.fits", head, padded(np.arange(10).astype(">i2").tobytes()))
    rows = api.getdata(path).orderBy("group").collect()
    assert rows[0]["params"] == [0.0, 6.0] and rows[0]["data"] == [2.0, 3.0, 4.0]
    assert rows[1]["params"] == [10.0, 11.0] and rows[1]["data"] == [7.0, 8.0, 9.0]


def test_table_round_trip(session, tmp_path):
    rows = session.range(200).select(
        F.col("id").alias("rownum"), (F.col("id") % 3 == 0).alias("flag"), F.col("id").cast("smallint").alias("s"), (F.col("id") - 100).cast("tinyint").alias("b"), F.when(F.col("id") % 5 > 0, F.col("id") / 7).alias("d"),
        F.concat(F.lit("name "), F.col("id")).alias("t"), F.transform(F.sequence(F.lit(1), F.col("id") % 4 + 1), lambda x: x * 1.5).alias("v"), (F.col("id").cast("decimal(20,0)") + F.expr("18446744073709551000BD")).cast("decimal(20,0)").alias("u"),
    )
    path = str(tmp_path / "t.fits")
    api.write_table(rows.repartitionByRange(3, "rownum").sortWithinPartitions("rownum"), path, widths="t:12", checksum=True, extname="TAB")
    back = api.table(path, extname="tab").orderBy("rownum").collect()
    for a, b in zip(rows.orderBy("rownum").collect(), back, strict=True):
        for n in rows.columns:
            assert a[n] == b[n] or (n == "d" and a[n] is None and (b[n] is None or b[n] != b[n])), n
    states = api.info(path).filter("hdu = 2").first()
    assert (states["datasum_status"], states["checksum_status"]) == ("match", "match")
    assert api.verify(path).filter("severity = 'err'").count() == 0
    with open(path, "r+b") as f:
        f.seek(-2880, 2)
        f.write(b"\xff")
    assert {r["kw"] for r in api.verify(path).filter("severity = 'err'").collect()} == {"DATASUM", "CHECKSUM"}


def test_image_round_trip_append_and_edit(session, tmp_path):
    path = str(tmp_path / "i.fits")
    pixels = session.range(12).select(F.col("id").alias("pix"), (F.col("id") * 7 - 11).cast("smallint").alias("value"))
    api.write_image(pixels.filter("pix <> 5"), path, [4, 3], checksum=True)
    api.write_image(pixels.withColumn("value", F.col("value") * 0.5), path, [3, 4], append=True, extname="HALF")
    assert [r["value"] for r in api.image(path, hdu=1).orderBy("pix").collect()] == [0 if i == 5 else 7 * i - 11 for i in range(12)]
    assert [r["value"] for r in api.image(path, extname="half").orderBy("pix").collect()] == [(7 * i - 11) / 2 for i in range(12)]
    api.copy_hdu(path, 2)
    assert api.info(path).count() == 3
    api.edit_header(path, 2, update={"OBSERVER": ("Ann", "who"), "LONG": "x" * 150}, rename={"EXTNAME": "EXTNAME"})
    assert api.getval(path, "OBSERVER", 2) == "Ann" and api.getval(path, "LONG", 2) == "x" * 150
    api.delete_hdu(path, 3)
    assert api.info(path).count() == 2
    api.save_gzip(path, f"{path}.gz")
    assert api.image(f"{path}.gz", hdu=1).count() == 12


@pytest.mark.parametrize(("codec", "tile"), [("RICE_1", None), ("GZIP_1", [5, 4]), ("GZIP_2", [16, 16]), ("PLIO_1", [7, 3]), ("HCOMPRESS_1", [6, 5])])
def test_compressed_images(session, tmp_path, codec, tile):
    path = str(tmp_path / "c.fits")
    pixels = session.range(16 * 16).select(F.col("id").alias("pix"), F.col("id").cast("int").alias("value"))
    api.write_compressed(pixels, path, [16, 16], codec, tile)
    assert [r["value"] for r in api.getdata(path).orderBy("pix").collect()] == list(range(256))


def test_quantized_image(session, tmp_path):
    path = str(tmp_path / "q.fits")
    pixels = session.range(200).select(F.col("id").alias("pix"), F.when(F.col("id") == 7, float("nan")).otherwise(F.sin("id")).cast("float").alias("value"))
    api.write_compressed(pixels, path, [20, 10], "GZIP_2", dither=3)
    both = api.getdata(path).withColumnRenamed("value", "w").join(pixels, "pix").collect()
    assert all((r["w"] is None or r["w"] != r["w"]) if r["pix"] == 7 else abs(r["w"] - r["value"]) < 3e-5 for r in both)


FIXED = {
    "RICE_1": np.array([7, 9, 11, 13, 100, 99, 98, 97, -5, -4, -3, -2], np.int16), "GZIP_1": np.arange(1, 13, dtype=np.int32), "GZIP_2": np.array([100, -200, 300, -400, 500, -600, 700, -800], np.int16),
    "PLIO_1": np.array([0, 0, 5, 5, 5, 0, 3, 0, 0, 7, 7, 0], np.int32), "HCOMPRESS_1": np.array([1, 2, 3, 4, 10, 11, 12, 13, -7, -6, -5, -4], np.int32),
}


@pytest.mark.parametrize("codec", sorted(FIXED))
def test_codecs(codec):
    v = FIXED[codec]
    data = codecs.encode(codec, v, shape=(3, 4))
    assert (codecs.decode(codec, data, len(v), v.dtype) == v).all()


def test_codecs_at_random():
    r = np.random.default_rng(1)
    for t in range(60):
        shape = tuple(int(x) for x in r.integers(1, 14, 2))
        x = r.integers(-(10 ** (t % 9)), 10 ** (t % 9) + 1, shape)
        assert (hcompress.decode(hcompress.encode(x)) == x).all()
        y = (np.cumsum(r.integers(-3, 4, 70)) if t % 2 else r.integers(-(1 << 31), 1 << 31, 70)).astype(np.int32)
        assert (codecs.rice_decode(codecs.rice_encode(y, 4), 70, 4) == y).all()
    with pytest.raises(errors.CorruptData):
        codecs.rice_decode(b"\0", 5, 4)
    with pytest.raises(errors.CorruptData):
        codecs.gzip_decode(codecs.gzip_encode(b"abc"), 5)


def test_random_sequence():
    seed = 1
    for _ in range(10_000):
        seed = seed * 16807 % 2147483647
    assert seed == 1043618065  # fixed by the standard
    assert len(codecs.random_sequence()) == 10_000 and len(codecs.dither(10_000, 25_000, 10_000)) == 25_000


def test_hostile_files(session, tmp_path):
    huge = block([("SIMPLE", True), ("BITPIX", 64), ("NAXIS", 3), *[(f"NAXIS{i}", 4_000_000_000) for i in (1, 2, 3)]])
    cases = {
        errors.LimitExceeded: huge, errors.MissingEnd: b"SIMPLE  =                    T".ljust(2880), errors.BadBitpix: block([("SIMPLE", True), ("BITPIX", 7), ("NAXIS", 0)]),
        errors.MissingRequiredKeyword: block([("BITPIX", 8), ("SIMPLE", True), ("NAXIS", 0)]), errors.BadCard: b"SIMPLE\x07 =                    T".ljust(2880),
    }
    for error, data in cases.items():
        path = write(tmp_path / "h.fits", data)
        with pytest.raises(error), open_file(path) as f:
            list(scan(f, size_of(f)))
    path = write(tmp_path / "x.fits", PRIMARY, b"special records".ljust(2880))
    with open_file(path) as f:
        assert len(list(scan(f, size_of(f)))) == 1
    with pytest.raises(errors.NotFound):
        open_file(str(tmp_path / "none.fits"))


@pytest.mark.parametrize("form", ["", "5", "3G", "1Jx", "999999999999999999999J", "2PJ", "1P"])
def test_bad_formats(form):
    with pytest.raises(errors.BadTform):
        parse_binary(form)


def test_formats():
    assert parse_binary("12X") == ("X", 12, None) and parse_binary("PE(40)") == ("P", 1, "E") and parse_ascii("E15.7") == ("E", 15, 7)
    assert parse_dims("(2,3)", 6) == (2, 3)
    with pytest.raises(errors.BadTdim):
        parse_dims("(4,3)", 6)
    assert ascii_integer(" +12 ") == 12 and ascii_real("31416", 4) == 3.1416
    with pytest.raises(errors.BadValue):
        ascii_integer("1_2")


def test_cards_and_headers():
    c = Card.parse(card("OBJECT", "O'Neil", "who").decode())
    assert (c.value, c.comment) == ("O'Neil", "who")
    assert Card.parse(card("ESO TEL ALT", 1.5).decode()).name == "ESO TEL ALT"
    assert Card.parse(card("Z", complex(1, -2)).decode()).value == complex(1, -2)
    long = card("LONG", "it's " * 60)
    cards = [Card.parse(long[a : a + 80].decode()) for a in range(0, len(long), 80)]
    assert Header(cards).text("LONG") == ("it's " * 60).rstrip()
    first = Header([Card.parse(card("A", 1).decode()), Card.parse(card("A", 2).decode())])
    assert first.integer("A") == 1
    with pytest.raises(errors.CardOverflow):
        card("A" * 60, 12345678901234567890)


@pytest.mark.parametrize(("name", "error"), [("", "EmptyPath"), ("a[", "UnbalancedBracket"), ("a[]", "EmptyBracket"), ("a[1]x", "TrailingChars"), ("a[0:3]", "BadSection"), ("a[1][E]", "DuplicateSelector"), ("a[#row<3]", "UnsupportedFilter"), ("a[bin 4]", "UnsupportedFilter"), ("a[E,x]", "BadExtVer")])
def test_bad_names(name, error):
    with pytest.raises(getattr(errors, error)):
        filespec.parse(name)


def test_template():
    data = api.build_template("# two HDUs\nSIMPLE = T\nBITPIX 8\nNAXIS = 0\nXTENSION = IMAGE\nBITPIX = 16\nNAXIS = 0\nNOTE# = 'a'\nNOTE# = 'b'\n")
    assert len(data) == 5760 and b"NOTE2   = 'b" in data
    with pytest.raises(errors.BadExtension):
        api.build_template("\\include x")


def test_group_members(session, tmp_path):
    path = str(tmp_path / "grp.fits")
    rows = session.createDataFrame([(0, 3, "", 0, ""), (1, 0, "first", 1, ""), (2, 0, "gone", 1, ""), (3, 3, "", 0, "http://x")], "rownum bigint, MEMBER_POSITION int, MEMBER_NAME string, MEMBER_VERSION int, MEMBER_LOCATION string").coalesce(1)
    api.write_table(rows, path, extname="GROUPING")
    pixels = session.range(4).select(F.col("id").alias("pix"), F.col("id").cast("int").alias("value"))
    api.write_image(pixels, path, [4], append=True, extname="FIRST")
    found = {r["rownum"]: r["hdu"] for r in api.group_members(path, 2).collect()}
    assert found == {0: 3, 1: 3, 2: None, 3: None}


def test_wcs_of_a_header(session, tmp_path):
    head = [("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 1), ("NAXIS2", 1), ("CTYPE1", "RA---TAN"), ("CTYPE2", "DEC--TAN"), ("CRPIX1", 32.0), ("CRPIX2", 32.0), ("CRVAL1", 150.0), ("CRVAL2", 2.5), ("CDELT1", -6e-4), ("CDELT2", 6e-4)]
    w = api.wcs(write(tmp_path / "w.fits", block(head), padded(b"\0")))
    assert w.crpix == (32.0, 32.0) and w.projection == "TAN" and w.m[0][0] == -6e-4


def test_content_and_streams(session, tmp_path, monster):
    import shutil

    from astrolith.sources import content
    from astrolith.streaming import arriving

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        shutil.copy(monster, folder / f"{k}.fits")
    rows = content.read(session, str(folder), columns=["STR", "INT32"])
    assert rows.count() == 6 and rows.columns == ["rownum", "STR", "INT32"]
    assert content.read(session, str(folder), mode="hdus").filter("kind = 'binary_table'").count() == 2
    stream = arriving(session, str(folder), rows.schema, columns=["STR", "INT32"])
    query = stream.groupBy("STR").agg(F.sum("INT32").alias("s")).writeStream.outputMode("complete").format("memory").queryName("arrived").start()
    query.processAllAvailable()
    shutil.copy(monster, folder / "2.fits")
    query.processAllAvailable()
    query.stop()
    assert {r["STR"]: r["s"] for r in session.table("arrived").collect()} == {"alpha": -300000, "beta": 0, None: 300000}


def test_compressed_table(session, tmp_path):
    cols = [(">i4", "J", "GZIP_1", np.arange(10)), (">f8", "2D", "GZIP_2", np.arange(20) / 4)]
    rows, heap = b"", b""
    for t in range(3):
        for kind, form, codec, values in cols:
            per = int(form[:-1] or 1)
            part = values[t * 4 * per : min(10, t * 4 + 4) * per].astype(kind)
            data = b"" if t == 1 and form == "J" else codecs.encode(codec, part.astype(part.dtype.newbyteorder("=")))
            rows += struct.pack(">ii", len(data), len(heap))
            heap += data
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 16), ("NAXIS2", 3), ("PCOUNT", len(heap)), ("GCOUNT", 1), ("TFIELDS", 2), ("TTYPE1", "A"), ("TFORM1", "1PB"), ("TTYPE2", "B"), ("TFORM2", "1PB")]
    head += [("ZTABLE", True), ("ZTILELEN", 4), ("ZNAXIS1", 20), ("ZNAXIS2", 10), ("ZFORM1", "J"), ("ZCTYP1", "GZIP_1"), ("ZFORM2", "2D"), ("ZCTYP2", "GZIP_2")]
    path = write(tmp_path / "z.fits", PRIMARY, block(head), padded(rows + heap))
    got = api.table(path).orderBy("rownum").collect()
    assert [r["A"] for r in got] == [0 if 4 <= i < 8 else i for i in range(10)]
    assert [r["B"] for r in got] == [[i / 2, i / 2 + 0.25] for i in range(10)]
    assert [r["A"] for r in api.table(path, rows="3:8", partitionRows=2).orderBy("rownum").collect()] == [3, 0, 0, 0, 0, 8]


def test_ascii_and_groups_round_trip(session, tmp_path):
    path = str(tmp_path / "a.fits")
    rows = session.createDataFrame([(0, 5, 0.25, "alpha"), (1, None, -3.75, None), (2, -20, 1e-300, "gamma")], "rownum bigint, COUNT int, VAL double, LABEL string").coalesce(1)
    api.write_ascii(rows, path, widths="COUNT:6,LABEL:8", checksum=True)
    back = [tuple(r) for r in api.table(path).orderBy("rownum").collect()]
    assert back == [(0, 5, 0.25, "alpha"), (1, None, -3.75, None), (2, -20, 1e-300, "gamma")]
    assert api.info(path).filter("hdu = 2 and checksum_status = 'match' and kind = 'ascii_table'").count() == 1
    assert api.verify(path).filter("severity = 'err'").count() == 0
    with pytest.raises(Exception, match="FieldOverflow"):
        api.write_ascii(rows, path, widths="LABEL:3")
    groups = session.createDataFrame([([1.0, 2.0], [0.5] * 6), ([3.0, 4.0], [1.5] * 6)], "params array<double>, data array<double>").coalesce(1)
    api.write_groups(groups, path, [3, 2])
    assert [(r["params"], r["data"]) for r in api.getdata(path).orderBy("group").collect()] == [([1.0, 2.0], [0.5] * 6), ([3.0, 4.0], [1.5] * 6)]


def test_findings(session, tmp_path):
    head = [("XTENSION", "TABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 5), ("NAXIS2", 0), ("GCOUNT", 1), ("PCOUNT", 0), ("TFIELDS", 1), ("TFORM1", "I6"), ("TBCOL1", 1), ("OBJECT", "a"), ("OBJECT", "b")]
    path = write(tmp_path / "v.fits", PRIMARY, block(head), b"junk".ljust(2880))
    found = {(r["hdu"], r["severity"], r["kw"]) for r in api.verify(path).collect()}
    assert found == {(2, "err", "GCOUNT"), (2, "err", "PCOUNT"), (2, "err", "TBCOL1"), (2, "warning", "OBJECT"), (3, "err", "")}
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 5), ("NAXIS2", 0), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 2), ("TFORM1", "1J"), ("TFORM2", "2A"), ("TSCAL2", 2.0)]
    path = write(tmp_path / "b.fits", PRIMARY, block(head))
    assert {(r["hdu"], r["severity"], r["kw"]) for r in api.verify(path).collect()} == {(2, "err", "NAXIS1"), (2, "warning", "TSCAL2")}


def test_header_search_and_status():
    lines = [card(n, 1) for n in ("NAXIS1", "NAXIS2", "NAXISX")] + [card("ESO TEL ALT", 2)]
    h = Header([Card.parse(c.decode()) for c in lines])
    assert [c.name for c in h.find("naxis#")[0]] == ["NAXIS1", "NAXIS2"] and h.find("*", 2)[1]
    assert h.find("HIERARCH ESO*")[0][0].value == 2
    assert errors.status(errors.KeywordNotFound("x")) == 202 and errors.status("Overflow") == 412


def test_wcs_cards_round_trip(session, tmp_path):
    from astrolith.functions import sky

    w = sky.Celestial((3.0, 4.0), (10.0, -20.0), sky.matrix((-0.1, 0.1), crota=20.0), "ZEA", 170.0)
    path = str(tmp_path / "w.fits")
    head = [("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), *sky.to_cards(w)]
    write(tmp_path / "w.fits", block(head))
    got = api.wcs(path)
    assert (got.crpix, got.crval, got.m, got.projection, got.lonpole) == (w.crpix, w.crval, w.m, "ZEA", 170.0)


def test_many_files(session, tmp_path, monster):
    import shutil

    for k in range(3):
        shutil.copy(monster, tmp_path / f"part{k}.fits")
    assert api.table(str(tmp_path), columns="INT32").count() == 12  # the fixture's own file is there too
    found = api.table(str(tmp_path / "part*.fits"), columns="INT32", withPath="true")
    assert found.columns == ["path", "rownum", "INT32"] and found.count() == 9
    assert found.select("path").distinct().count() == 3
    from astrolith.sources import fits

    before, fits.SPLIT_FILES = fits.SPLIT_FILES, 2
    try:
        assert found.filter("rownum >= 2").count() == 3
    finally:
        fits.SPLIT_FILES = before
    with pytest.raises(Exception, match="NotFound"):
        api.table(str(tmp_path / "none*.fits")).count()


def test_filters_do_not_stick(session, tmp_path):
    path = str(tmp_path / "t.fits")
    api.write_table(session.range(1000).select(F.col("id").alias("rownum"), F.col("id").cast("int").alias("v")), path)
    d = api.table(path, partitionRows=100)
    assert (d.count(), d.filter("rownum < 5").count(), d.count()) == (1000, 5, 1000)
    assert d.filter("rownum < 5").union(d.filter("rownum >= 995")).count() == 10
    low, high = d.filter("rownum < 5").alias("a"), d.filter("rownum >= 995").alias("b")
    assert low.join(high, F.col("a.rownum") + 995 == F.col("b.rownum")).count() == 5


@pytest.mark.parametrize("bitpix", [8, 16, 32, 64, -32, -64])
def test_sections_and_filters(session, tmp_path, bitpix):
    kind = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[bitpix]
    data = (np.arange(10 * 12 * 3) % 120).reshape(3, 12, 10).astype(kind)
    path = write(tmp_path / "i.fits", block([("SIMPLE", True), ("BITPIX", bitpix), ("NAXIS", 3), ("NAXIS1", 10), ("NAXIS2", 12), ("NAXIS3", 3)]), padded(data.tobytes()))
    for section, cut in (("3:6,5:8,2", data[1:2, 4:8, 2:6]), ("2:9:3,*,1:3:2", data[::2, :, 1:9:3]), ("*,12,*", data[:, 11:, :]), ("10,1:12:5,3", data[2:, ::5, 9:])):
        for rows in (1 << 20, 3):
            d = api.image(f"{path}[{section}]", partitionRows=rows)
            assert [(r["pix"], r["value"]) for r in d.orderBy("pix").collect()] == list(enumerate(cut.ravel().tolist())), section
            assert d.filter("pix < 4").count() == min(4, cut.size) and d.count() == cut.size
            c1, c2 = (sorted({r[c] for r in d.collect()}) for c in ("c1", "c2"))
            assert len(c1) == cut.shape[2] and len(c2) == cut.shape[1]
    assert [r["pix"] for r in api.image(path, rows="7:11").orderBy("pix").collect()] == [7, 8, 9, 10, 11]
    with pytest.raises(Exception, match="BadSection"):
        api.image(f"{path}[*,*,1]", rows="0:3").count()


def test_sections_of_images_of_different_shapes(session, tmp_path):
    for n in (4, 20):
        head = block([("SIMPLE", True), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", n), ("NAXIS2", n)])
        write(tmp_path / f"{n:02}.fits", head, padded(np.arange(n * n).astype(">i2").tobytes()))
    assert api.image(str(tmp_path), section="*,*").count() == 416
    assert api.image(str(tmp_path), section="2:4,1:4:2", withPath="true").groupBy("path").count().collect()[0]["count"] == 6
    with pytest.raises(Exception, match="BadDimensions"):
        api.image(str(tmp_path), section="1:5,1").count()


def test_long_lines_are_cut_in_pieces(session, tmp_path, monkeypatch):
    from astrolith.sources import fits

    monkeypatch.setattr(fits, "LINE_PIXELS", 3)
    data = np.arange(60).reshape(3, 20).astype(">i2")
    path = write(tmp_path / "i.fits", block([("SIMPLE", True), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", 20), ("NAXIS2", 3)]), padded(data.tobytes()))
    plan = {"paths": [path], "with_path": False, "mode": "image", "hdu": None, "extname": None, "extver": None, "section": filespec.parse("x[2:19:2,1:3:2]").section, "columns": None, "rows": None, "raw": False, "size": 4}
    reader = fits.ImageReader(plan, fits.ImageReader.infer(plan))
    parts = reader.partitions()
    got = [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]
    assert len(parts) > 3 and got == data[::2, 1:19:2].ravel().tolist()


def test_only_the_tiles_that_are_asked_for_are_decoded(session, tmp_path, monkeypatch):
    from astrolith.sources import fits

    path = str(tmp_path / "c.fits")
    pixels = session.range(64 * 64).select(F.col("id").alias("pix"), (F.col("id") % 1000).cast("int").alias("value"))
    api.write_compressed(pixels, path, [64, 64], "RICE_1", [8, 8])
    decoded, plain = [], codecs.decode
    monkeypatch.setattr(codecs, "decode", lambda *a: decoded.append(1) or plain(*a))

    def read(**options):
        decoded.clear()
        plan = {"paths": [path], "with_path": False, "mode": "image", "hdu": None, "extname": None, "extver": None, "section": None, "columns": None, "rows": None, "raw": False, "size": 512} | options
        reader = fits.ImageReader(plan, fits.ImageReader.infer(plan))
        return sorted((p, v) for part in reader.partitions() for b in reader.read(part) for p, v in zip(b.column("pix").to_pylist(), b.column("value").to_pylist(), strict=True))

    assert read() == [(i, i % 1000) for i in range(4096)] and len(decoded) == 64
    assert read(rows="100:130") == [(i, i % 1000) for i in range(100, 131)] and len(decoded) <= 8
    section = filespec.parse("x[1:9:4,20:30]").section
    assert [v for _, v in read(section=section)] == [(64 * y + x) % 1000 for y in range(19, 30) for x in (0, 4, 8)] and len(decoded) == 4


def test_texts_and_whole_zero_points(session, tmp_path):
    head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 22), ("NAXIS2", 4), ("PCOUNT", 12), ("GCOUNT", 1), ("TFIELDS", 3)]
    head += [("TTYPE1", "T"), ("TFORM1", "6A"), ("TTYPE2", "K"), ("TFORM2", "1K"), ("TZERO2", 1), ("TNULL2", -7), ("TTYPE3", "V"), ("TFORM3", "1PA")]
    texts, heap = [b"ab c  ", b"\xe9t\xe9\0zz", b"\0abcde", b"      "], b"one  \0x\xfc\xfc   "
    numbers, places = [(1 << 60) + 1, -7, (1 << 63) - 1, -(1 << 63)], [(5, 0), (2, 5), (0, 0), (5, 7)]
    rows = b"".join(t + struct.pack(">qii", n, *p) for t, n, p in zip(texts, numbers, places, strict=True))
    path = write(tmp_path / "t.fits", PRIMARY, block(head), padded(rows + heap))
    got = api.table(path).orderBy("rownum").collect()
    assert [r["T"] for r in got] == ["ab c", "\u00e9t\u00e9", None, ""]
    assert [None if r["K"] is None else int(r["K"]) for r in got] == [(1 << 60) + 2, None, 1 << 63, -(1 << 63) + 1]
    assert [r["V"] for r in got] == ["one", "", "", "\u00fc\u00fc"]


def test_ascii_numbers_of_all_forms(session, tmp_path):
    cells = ["  1.5", " +2.", "  .25", " 314", "1D2", "1.E-3", "5+2", "-7.5d1", "", "***"]
    head = [("XTENSION", "TABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 16), ("NAXIS2", len(cells)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 2)]
    head += [("TTYPE1", "R"), ("TBCOL1", 1), ("TFORM1", "F8.2"), ("TTYPE2", "I"), ("TBCOL2", 9), ("TFORM2", "I8"), ("TNULL1", "***")]
    data = "".join(c.ljust(8) + f"{(-1) ** i * i:+8}" for i, c in enumerate(cells)).encode()
    got = api.table(write(tmp_path / "a.fits", PRIMARY, block(head), padded(data, b" "))).orderBy("rownum").collect()
    assert [r["R"] for r in got] == [1.5, 2.0, 0.25, 3.14, 1.0, 1e-3, 5.0, -75.0, None, None]
    assert [r["I"] for r in got] == [(-1) ** i * i for i in range(len(cells))]


def test_pieces_of_a_file():
    import io

    from astrolith.sources.fits import gather

    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 300_000).astype(np.uint8)
    for spread in (300, 299_000):
        offsets, sizes = rng.integers(0, spread, 200), rng.integers(0, 60, 200)
        want = np.concatenate([data[100 + a : 100 + a + n] for a, n in zip(offsets.tolist(), sizes.tolist(), strict=True)])
        assert (gather(io.BytesIO(data.tobytes()), 100, offsets, sizes) == want).all()
    assert len(gather(io.BytesIO(b""), 0, offsets[:0], sizes[:0])) == 0


def test_nulls_come_back(session, tmp_path):
    kinds = "rownum bigint, b tinyint, s smallint, i int, k bigint, u decimal(20,0), f float, d double, l boolean, t string, z struct<re:double,im:double>"
    rows = [(0, 5, -7, 1 << 20, -(1 << 62), Decimal(7), 1.5, 2.5, True, "one", (1.0, 2.0)), (1, *[None] * 8, None, (3.0, 4.0)), (2, 127, 32767, -5, 0, Decimal((1 << 64) - 2), -0.5, 0.0, False, "", (0.0, 0.0))]
    df = session.createDataFrame(rows, kinds).repartitionByRange(2, "rownum")
    path = str(tmp_path / "n.fits")
    api.write_table(df, path, checksum=True)
    back = [tuple(r) for r in api.table(path).orderBy("rownum").collect()]
    nan = lambda row: tuple(None if x != x else tuple(x) if isinstance(x, tuple) else x for x in row)
    assert [nan(r) for r in back] == [nan(r) for r in rows]
    assert api.getval(path, "TNULL2", 2) == -32768 and api.verify(path).filter("severity = 'err'").count() == 0
    taken = session.createDataFrame([(-32768,), (None,)], "s smallint")
    with pytest.raises(Exception, match="stands for null"):
        api.write_table(taken, path)
    api.write_table(taken, path, nulls="s:99")
    assert {r["s"] for r in api.table(path).collect()} == {-32768, None}
    with pytest.raises(Exception, match="null inside an array"):
        api.write_table(session.sql("select array(1, null) as a"), path)
    with pytest.raises(Exception, match="no Latin-1"):
        api.write_table(session.createDataFrame([("\u4e2d\u6587",)], "t string"), path)
    api.write_table(session.createDataFrame([("caf\u00e9",), (None,), ("",)], "t string").coalesce(1), path)
    assert [r["t"] for r in api.table(path).orderBy("rownum").collect()] == ["caf\u00e9", None, ""]


def test_scaled_columns_and_images(session, tmp_path):
    path = str(tmp_path / "s.fits")
    df = session.createDataFrame([(0, 10.5), (1, 11.24), (2, None), (3, -3.76)], "rownum bigint, v double").coalesce(1)
    api.write_table(df, path, scaled="v:I:0.5:10")
    assert [r["v"] for r in api.table(path).orderBy("rownum").collect()] == [10.5, 11.0, None, -4.0]
    assert [r["v"] for r in api.table(path, raw="true").orderBy("rownum").collect()] == [1, 2, -32768, -28]
    again = str(tmp_path / "again.fits")
    api.write_table(api.table(path).coalesce(1), again, scaled="keep")
    assert api.getval(again, "TFORM1", 2) == "1I" and [r["v"] for r in api.table(again).orderBy("rownum").collect()] == [10.5, 11.0, None, -4.0]
    with pytest.raises(Exception, match="Overflow"):
        api.write_table(df, path, scaled="v:B:0.001:10")
    pixels = session.createDataFrame([(i, v) for i, v in enumerate([100.0, 102.0, 200.0, None])], "pix bigint, value double")
    api.write_image(pixels, path, [4], bitpix=16, bscale=2, bzero=100)
    assert [r["value"] for r in api.image(path).orderBy("pix").collect()] == [100.0, 102.0, 200.0, None] and api.getval(path, "BLANK") == -32768
    whole = session.createDataFrame([(0, 7), (1, None)], "pix bigint, value int")
    api.write_image(whole, path, [2])
    assert [r["value"] for r in api.image(path).orderBy("pix").collect()] == [7, None]
    groups = session.createDataFrame([([1.0, 2.5], [4.0, 6.0]), ([3.0, 4.5], [8.0, None])], "params array<double>, data array<double>").coalesce(1)
    api.write_groups(groups, path, [2], bitpix=16, bscale=2, pscal="1,0.5", pzero="0,2")
    assert [(r["params"], r["data"]) for r in api.getdata(path).orderBy("group").collect()] == [([1.0, 2.5], [4.0, 6.0]), ([3.0, 4.5], [8.0, None])]


def test_large_heaps_have_wide_descriptors(session, tmp_path, monkeypatch):
    from astrolith.sources import fits_sink

    rows = session.range(40).select(F.col("id").alias("rownum"), F.transform(F.sequence(F.lit(1), F.col("id") % 5 + 1), lambda x: x * F.col("id")).alias("v")).repartitionByRange(3, "rownum").sortWithinPartitions("rownum")
    want = [r["v"] for r in rows.orderBy("rownum").collect()]
    for most, form in ((1 << 31, "1PK"), (100, "1QK")):
        monkeypatch.setattr(fits_sink, "NARROW_HEAP", most)
        parts = [fits_sink.Out("v", "K", 1, True)]
        writer = fits_sink.FitsWriter({"path": str(tmp_path / "q.fits")}, rows.schema, True)
        assert [o.name for o in writer.columns] == [o.name for o in parts]
        import pyarrow as pa

        made = []
        for n, batch in enumerate(rows.toArrow().to_batches(max_chunksize=7)):
            name, seen = f"{tmp_path}/{form}{n}", fits_sink.Seen()
            with open(f"{name}.rows", "wb") as out, open(f"{name}.heap", "wb") as heap:
                out.write(fits_sink.encode_rows(pa.RecordBatch.from_arrays(batch.columns, batch.schema.names), writer.columns, heap, seen))
                made.append(fits_sink.Part(n, name, batch.num_rows, heap.tell(), dict(seen)))
        writer.commit(made)
        path = str(tmp_path / "q.fits")
        assert api.getval(path, "TFORM1", 2) == form
        assert [r["v"] for r in api.table(path).orderBy("rownum").collect()] == want


@pytest.mark.parametrize("method", ["NO_DITHER", "SUBTRACTIVE_DITHER_2"])
def test_quantizing_methods(session, tmp_path, method):
    path = str(tmp_path / "q.fits")
    pixels = session.range(200).select(F.col("id").alias("pix"), F.when(F.col("id") == 7, float("nan")).when(F.col("id") % 10 == 0, 0.0).otherwise(F.sin("id")).cast("float").alias("value"))
    api.write_compressed(pixels, path, [20, 10], "GZIP_2", dither=None if method == "NO_DITHER" else 5, method=method)
    both = api.getdata(path).withColumnRenamed("value", "w").join(pixels, "pix").collect()
    assert all((r["w"] is None or r["w"] != r["w"]) if r["pix"] == 7 else abs(r["w"] - r["value"]) < 3e-5 for r in both)
    assert method == "NO_DITHER" or all(r["w"] == 0 for r in both if r["pix"] % 10 == 0)
    whole = session.range(64).select(F.col("id").alias("pix"), F.when(F.col("id") != 9, F.col("id").cast("int")).alias("value"))
    api.write_compressed(whole, path, [8, 8], "RICE_1", blank=-1)
    assert [r["value"] for r in api.getdata(path).orderBy("pix").collect()] == [None if i == 9 else i for i in range(64)]
    with pytest.raises(Exception, match="no blank"):
        api.write_compressed(whole, path, [8, 8], "RICE_1")


def states(path, hdu=1):
    r = api.info(path).filter(f"hdu = {hdu}").first()
    return r["datasum_status"], r["checksum_status"]


def test_edits_keep_checksums_and_whole_texts(session, tmp_path):
    path = str(tmp_path / "e.fits")
    pixels = session.range(12).select(F.col("id").alias("pix"), F.col("id").cast("smallint").alias("value"))
    api.write_image(pixels, path, [4, 3], checksum=True)
    api.edit_header(path, 1, update={"LONG": "x" * 150, "OBSERVER": ("Ann", "who")}, reserve=2)
    assert states(path) == ("match", "match") and api.getval(path, "LONG") == "x" * 150
    api.edit_header(path, 1, update={"LONG": "short", "NEW": 5}, insert=[(5, "HISTORY", "made by hand"), (99, "LAST", 1, "note")])
    names = [c.name for c in api.getheader(path).cards]
    assert "CONTINUE" not in names and api.getval(path, "LONG") == "short" and names.index("HISTORY") == 5
    assert names.index("NEW") > names.index("OBSERVER") and names.count("") == 1  # one blank card is filled
    assert states(path) == ("match", "match")
    with pytest.raises(errors.BadKeyword):
        api.edit_header(path, 1, delete=["BITPIX"])
    with pytest.raises(errors.BadKeyword):
        api.edit_header(path, 1, insert=[(1, "A", 1)])
    api.reshape_image(path, 1, 8, [5, 2, 3])
    got = [r["value"] for r in api.image(path).orderBy("pix").collect()]
    assert got == [b for i in range(12) for b in (0, i)] + [0] * 6 and states(path) == ("match", "match")
    api.reshape_image(path, 1, 16, [3])
    assert [r["value"] for r in api.image(path).orderBy("pix").collect()] == [0, 1, 2]


def test_checksums_of_an_existing_file(session, tmp_path, monster):
    assert states(monster, 2) == ("not_present", "not_present")
    api.update_checksums(monster, 2)
    assert states(monster, 2) == ("match", "match") and states(monster) == ("not_present", "not_present")
    api.update_checksums(monster)
    assert states(monster) == states(monster, 2) == ("match", "match")
    with open(monster, "r+b") as f:
        f.seek(-2880, 2)
        f.write(b"\x07")
    assert states(monster, 2)[0] == "mismatch"
    api.update_checksums(monster)
    assert states(monster, 2) == ("match", "match") and api.table(monster).count() == 3


def test_pixels_and_sections_are_put_in_place(session, tmp_path):
    path = str(tmp_path / "p.fits")
    pixels = session.range(12).select(F.col("id").alias("pix"), F.lit(0).cast("smallint").alias("value"))
    api.write_image(pixels, path, [4, 3], checksum=True)
    api.write_image(pixels.withColumn("value", F.lit(9.0)), path, [4, 3], append=True, bitpix=16, bscale=2, bzero=1)
    api.write_section(session.createDataFrame([(i, 10 + i) for i in range(4)], "pix bigint, value int"), path, "1:3:2,1:3:2")
    want = [10, 0, 11, 0, 0, 0, 0, 0, 12, 0, 13, 0]
    assert [r["value"] for r in api.image(path, hdu=1).orderBy("pix").collect()] == want and states(path) == ("match", "match")
    api.write_pixels(session.createDataFrame([(5, 41.0)], "pix bigint, value double"), path, 2)
    assert [r["value"] for r in api.image(path, hdu=2).orderBy("pix").collect()] == [9.0] * 5 + [41.0] + [9.0] * 6
    with pytest.raises(Exception, match="BadDimensions"):
        api.write_section(session.createDataFrame([(4, 1)], "pix bigint, value int"), path, "1:3:2,1:3:2")
    with pytest.raises(Exception, match="Overflow"):
        api.write_pixels(session.createDataFrame([(5, 1 << 20)], "pix bigint, value int"), path)
    seen = api.for_each_image(path, lambda first, values: [first] * len(values), group=5, hdu=1)
    assert {r["value"] for r in seen.collect()} <= {0, 5, 10}
    import pyarrow.compute as pc

    api.for_each_image(path, lambda first, values: pc.add(values, 1), hdu=1, write_back=True)
    assert [r["value"] for r in api.image(path, hdu=1).orderBy("pix").collect()] == [x + 1 for x in want] and states(path) == ("match", "match")


def test_places_among_hdus(session, tmp_path, monster):
    hdus = api.Hdus(monster)
    assert len(hdus) == 2 and hdus.current.kind == "primary" and hdus.move(1).extname == "MONSTER" and hdus.number == 2
    with pytest.raises(errors.WrongHduType):
        hdus.move(1)
    assert hdus.select(1).number == 1


def test_findings_about_headers_and_sums(session, tmp_path):
    path = write(tmp_path / "x.fits", b"SIMPLE  =                    T".ljust(2880))
    assert [(r["hdu"], r["kw"]) for r in api.verify(path).collect()] == [(1, "END")]
    path = write(tmp_path / "y.fits", PRIMARY, b"XTENSION= 'IMAGE   '".ljust(2880))
    assert ("END", "err") in {(r["kw"], r["severity"]) for r in api.verify(path).collect()}
    path = write(tmp_path / "z.fits", block([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("DATASUM", "many"), ("CHECKSUM", "short")]))
    assert {(r["kw"], r["severity"]) for r in api.verify(path).collect()} == {("DATASUM", "warning"), ("CHECKSUM", "warning")}
    path = write(tmp_path / "c.fits", block([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 1), ("NAXIS1", 9000), ("DATASUM", "1")]), b"\0" * 2880)
    assert ("DATASUM", "warning") in {(r["kw"], r["severity"]) for r in api.verify(path).collect()}
    bad = write(tmp_path / "w.fits", PRIMARY, block([("XTENSION", "IMAGE"), ("BITPIX", 7), ("NAXIS", 0)]))
    with pytest.raises(errors.BadBitpix), open_file(bad) as f:
        list(scan(f, size_of(f)))


def test_append_after_special_records(session, tmp_path):
    path = write(tmp_path / "s.fits", PRIMARY, b"special records".ljust(2880))
    with pytest.raises(Exception, match="special records"):
        api.write_image(session.range(4).select(F.col("id").alias("pix"), F.col("id").cast("int").alias("value")), path, [4], append=True)


def test_roles_and_sentinels(session):
    import pyarrow as pa
    import pyarrow.compute as pc

    from astrolith.operators import work

    df = session.createDataFrame([(1, None, 2.0), (2, 5, None)], "k int, a smallint, x double").coalesce(1)

    def change(batch):
        assert batch.schema.names == ["k", "a"] and batch.column("a").null_count == 0
        return {"a": pc.if_else(pc.equal(batch.column("a"), -1), batch.column("a"), pc.cast(pc.add(batch.column("a"), 1), pa.int16())), "k2": pc.multiply(batch.column("k"), 2)}

    got = work.run(df, change, "a smallint, k2 int", roles={"k": "in", "a": "inout", "k2": "out"}, sentinels={"a": -1, "k": 1 << 40})
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 2), (6, 4)], key=str)
    with pytest.raises(errors.NoSuchColumn):
        work.run(df, change, "a smallint", roles={"none": "in"})
    with pytest.raises(Exception, match="NoSuchColumn"):
        work.run(df, lambda b: {}, "a smallint").collect()
    assert work.sentinel_of(300, pa.int8()) is None and work.sentinel_of(1.5, pa.int32()) is None and work.sentinel_of(-1, pa.int16()) == -1


def test_continue_without_an_ampersand(session):
    from astrolith.functions import cards as card_ops
    from astrolith.functions import checksum

    rows = [(1, 0, True, "no amp"), (1, 1, False, "tail"), (1, 2, False, "more"), (1, 3, True, "one&"), (1, 4, False, "two&"), (1, 5, True, "end&")]
    df = session.createDataFrame(rows, "hdu int, idx int, base boolean, text string")
    got = card_ops.assemble(df, ["hdu"], "idx", "base", "text").orderBy("idx").collect()
    assert [(r["idx"], r["text"]) for r in got] == [(0, "no amp"), (3, "onetwo&"), (5, "end&")]
    one, two = (d.agg(checksum.fingerprint(df)).first()[0] for d in (df, df.orderBy(F.desc("idx"))))
    assert one == two and one != df.filter("idx < 5").agg(checksum.fingerprint(df)).first()[0]


def test_headers_are_mappings(session, tmp_path):
    path = str(tmp_path / "h.fits")
    api.write_image(session.range(4).select(F.col("id").alias("pix"), F.col("id").cast("int").alias("value")), path, [4], checksum=True)
    h = api.getheader(path)
    h["EXPTIME"] = (2.0, "[s] time")
    h["LONG"] = "y" * 200
    h["NOTHING"] = None
    h["Z"] = complex(1, 2)
    h.add_history("first")
    h.add_comment("c" * 100)
    assert h.unit("EXPTIME") == "s" and h.typed("EXPTIME", int) == 2 and h.typed("NAXIS1", float) == 4.0 and h.typed("Z", complex) == 1 + 2j
    h["LONG"], h["EXPTIME"] = "z", 3.5
    assert h.comment("EXPTIME") == "[s] time" and "CONTINUE" not in [c.name for c in h.cards] and dict(h.items())["LONG"] == "z"
    for name, kind, error in (("NOTHING", int, "ValueUndefined"), ("MISSING", int, "KeywordNotFound"), ("LONG", int, "WrongValueType"), ("EXPTIME", int, "WrongValueType"), ("SIMPLE", int, "WrongValueType")):
        with pytest.raises(getattr(errors, error)):
            h.typed(name, kind)
    del h["Z"]
    with pytest.raises(errors.KeywordNotFound):
        del h["Z"]
    api.put_header(path, h)
    back = api.getheader(path)
    assert "Z" not in back and back["EXPTIME"] == 3.5 and back.history == ["first"] and "".join(back.comments) == "c" * 100
    assert states(path) == ("match", "match") and len(back) == len(list(back)) and list(back.keys())[0] == "SIMPLE"
    h["NAXIS1"] = 5000
    with pytest.raises(errors.BadDimensions):
        api.put_header(path, h)


@pytest.mark.parametrize("ranges", [True, False])
def test_files_behind_urls(session, tmp_path, monster, ranges):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        asked = []

        def answer(self, body):
            name = tmp_path / self.path.lstrip("/")
            if not name.exists():
                self.send_error(404)
                return
            data, said = name.read_bytes(), self.headers["Range"]
            total = len(data)
            if said and ranges:
                first, last = (int(x) for x in said.removeprefix("bytes=").split("-"))
                if first >= total:
                    self.send_error(416)
                    return
                data = data[first : last + 1]
                self.send_response(206)
                self.send_header("Content-Range", f"bytes {first}-{first + len(data) - 1}/{total}")
            else:
                self.send_response(200)
            if body or ranges:
                self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            if body:
                Handler.asked.append(len(data))
                self.wfile.write(data)

        def do_GET(self):  # noqa: N802
            self.answer(True)

        def do_HEAD(self):  # noqa: N802
            self.answer(False)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}"
        assert [r["INT32"] for r in api.table(f"{url}/m.fits").orderBy("rownum").collect()] == [-100000, 0, 100000]
        api.save_gzip(monster, f"{monster}.gz")
        assert api.info(f"{url}/m.fits.gz").count() == 2
        with pytest.raises(Exception, match="NotFound"):
            api.table(f"{url}/none.fits").count()
        with pytest.raises(Exception, match="NotFound"):
            api.table("other://host/m.fits").count()
    finally:
        server.shutdown()
        server.server_close()


def test_a_folder_of_files(session, tmp_path):
    path = str(tmp_path / "many")
    rows = session.range(100).select(F.col("id").alias("rownum"), F.col("id").cast("int").alias("v"), F.array(F.col("id")).alias("a")).repartition(4)
    for checksum in (False, True):
        api.write_table(rows.filter("v % 7 > 0") if checksum else rows, path, files=True, checksum=checksum)
        back = api.table(path, withPath="true")
        want = {(i, i) for i in range(100) if i % 7 or not checksum}
        assert {(r["v"], r["a"][0]) for r in back.collect()} == want and back.select("path").distinct().count() == 4
    assert {states(r["path"], 2) for r in back.select("path").distinct().collect()} == {("match", "match")}
    assert [x.name for x in tmp_path.iterdir()] == ["many"]
    api.write_table(rows.limit(0), path, files=True)
    assert api.table(path).count() == 0
    with pytest.raises(Exception, match="files are of tables"):
        api.write_image(rows.select(F.col("v").cast("bigint").alias("pix"), F.col("v").alias("value")), path, [100], files=True)
