"""Queries of sky and spectral coordinates, times, display formats, tiles, dithering, codecs and work functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import arrays, display, sky, times
from ..operators import tiles as tile_ops
from ..operators import work
from ..sources import codecs
from .registry import query, table

CRPIX, CRVAL, CDELT = (256.0, 256.0), (150.0, 2.5), (-6e-4, 6e-4)
_P1, _P2 = "(l_partkey % 512 + 1)::double", "(l_suppkey % 512 + 1)::double"
_R0 = "(180.0::double / pi())"
_SKY = """
with p as (select l_orderkey, l_linenumber, {x} as x, {y} as y from lineitem),
n as (select *, sqrt(x * x + y * y) as r, case when x = 0 and y = 0 then 0.0::double else atan2(x, -y) end as phi0 from p),
t as (select l_orderkey, l_linenumber, {phi} as phi, {theta} as theta from n),
c as (select l_orderkey, l_linenumber,
  asin(greatest(-1.0::double, least(1.0::double, sin(theta) * sin({dp}) + cos(theta) * cos({dp}) * cos(phi - {pp})))) as d,
  {ap} + atan2(-cos(theta) * sin(phi - {pp}), sin(theta) * cos({dp}) - cos(theta) * sin({dp}) * cos(phi - {pp})) as a from t)
select l_orderkey, l_linenumber, round(degrees(a) - floor(degrees(a) / 360.0) * 360.0, 7) as ra, round(degrees(d), 7) as dec from c
"""
#: The native latitude of each projection, in SQL.
_THETA = {
    "TAN": f"atan2({_R0}, r)", "SIN": f"acos(least(r / {_R0}, 1.0::double))", "ARC": "radians(90.0::double - r)",
    "STG": f"pi() / 2 - 2 * atan(r / (2 * {_R0}))", "ZEA": f"pi() / 2 - 2 * asin(least(r / (2 * {_R0}), 1.0::double))", "CAR": "radians(y)",
}


def _celestial(projection, m=None):
    return sky.Celestial(CRPIX, CRVAL, m or sky.matrix(CDELT), projection)


def _number(x: float) -> str:
    return f"'{x!r}'::double"


def _sky_sql(w: sky.Celestial) -> str:
    ap, dp, pp = map(_number, w.pole)
    d1, d2 = f"({_P1} - 256.0::double)", f"({_P2} - 256.0::double)"
    line = lambda row: f"{_number(row[0])} * {d1} + {_number(row[1])} * {d2}"
    phi = "radians(x)" if w.projection == "CAR" else "phi0"
    return _SKY.format(x=line(w.m[0]), y=line(w.m[1]), phi=phi, theta=_THETA[w.projection], ap=ap, dp=dp, pp=pp)


def _pixels(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 512 + 1).cast("double").alias("p1"), (F.col("l_suppkey") % 512 + 1).cast("double").alias("p2"))


def _register_sky(projection):
    w = _celestial(projection)

    @query(_sky_sql(w), f"wcs_{projection.lower()}_pix2world")
    def forward(spark, d):
        ra, dec = sky.pixel_to_world(F.col("p1"), F.col("p2"), w)
        return _pixels(spark, d).select("l_orderkey", "l_linenumber", F.round(ra, 7).alias("ra"), F.round(dec, 7).alias("dec"))

    # There and back again: the pixel, to a millionth.
    @query(f"select l_orderkey, l_linenumber, {_P1} as p1, {_P2} as p2 from lineitem", f"wcs_{projection.lower()}_world2pix")
    def back(spark, d):
        rows = _pixels(spark, d)
        ra, dec = sky.pixel_to_world(F.col("p1"), F.col("p2"), w)
        rows = rows.select("l_orderkey", "l_linenumber", ra.alias("ra"), dec.alias("dec"))
        p1, p2 = sky.world_to_pixel(F.col("ra"), F.col("dec"), w)
        return rows.select("l_orderkey", "l_linenumber", F.round(p1, 6).alias("p1"), F.round(p2, 6).alias("p2"))


for _name in sky.PROJECTIONS:
    _register_sky(_name)

_MATRICES = {"cd": sky.matrix(cd=[[-6e-4, 1e-5], [2e-5, 6e-4]]), "pc": sky.matrix(CDELT, pc=[[1.0, 0.1], [-0.1, 1.0]]), "crota": sky.matrix(CDELT, crota=30.0)}


@query(" union all ".join(
    f"select l_orderkey, l_linenumber, '{k}' as form, round({_number(m[0][0])} * ({_P1} - 256.0) + {_number(m[0][1])} * ({_P2} - 256.0), 9) as x, "
    f"round({_number(m[1][0])} * ({_P1} - 256.0) + {_number(m[1][1])} * ({_P2} - 256.0), 9) as y from lineitem" for k, m in _MATRICES.items()
))
def wcs_cd_pc_crota(spark, d):
    rows, out = _pixels(spark, d), None
    for k, m in _MATRICES.items():
        x, y = sky.linear(F.col("p1"), F.col("p2"), _celestial("TAN", m))
        own = rows.select("l_orderkey", "l_linenumber", F.lit(k).alias("form"), F.round(x, 9).alias("x"), F.round(y, 9).alias("y"))
        out = own if out is None else out.unionByName(own)
    return out


@query("select l_orderkey, l_linenumber, round(1.42e9::double + 2.5e5::double * (l_linenumber - 1.0::double), 6) as freq from lineitem")
def spectral_value(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(sky.spectral_value(F.col("l_linenumber"), 1.42e9, 2.5e5), 6).alias("freq"))


@query("select l_orderkey, l_linenumber, round(1.0::double + (l_extendedprice - 1000.0::double) / 250.0::double, 9) as pixel from lineitem")
def spectral_pixel(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(sky.spectral_pixel(F.col("l_extendedprice"), 1000.0, 250.0), 9).alias("pixel"))


@query("select o_orderkey, epoch_us(o_orderdate) / 86400000000.0::double + 2440587.5::double as jd from orders")
def jd_from_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", times.julian_of(F.col("o_orderdate")).alias("jd"))


@query("select event_id, round(epoch_us(ts) / 86400000000.0::double + 2440587.5::double - 2400000.5::double, 7) as mjd from events")
def mjd_from_date(spark, d):
    return table(spark, d, "events").select("event_id", F.round(times.mjd(times.julian_of(F.col("ts"))), 7).alias("mjd"))


@query("select o_orderkey, year(o_orderdate)::int as y, month(o_orderdate)::int as m, day(o_orderdate)::int as dd from orders")
def date_from_jd(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", times.date_of(times.julian_of(F.col("o_orderdate"))).alias("t"))
    return rows.select("o_orderkey", F.col("t.year").alias("y"), F.col("t.month").alias("m"), F.col("t.day").alias("dd"))


@query("""
with j as (select o_orderkey, epoch_us(o_orderdate) / 86400000000.0::double + 2440587.5::double as jd from orders)
select o_orderkey, round(2000.0::double + (jd - 2451545.0::double) / 365.25::double, 9) as julian,
  round(1900.0::double + (jd - 2415020.31352::double) / 365.242198781::double, 9) as besselian from j
""")
def epochs(spark, d):
    jd = times.julian_of(F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", F.round(times.julian_epoch(jd), 9).alias("julian"), F.round(times.besselian_epoch(jd), 9).alias("besselian"))


@query("""
select o_orderkey, year(o_orderdate)::int as y, month(o_orderdate)::int as m, day(o_orderdate)::int as dd,
  case when o_orderkey % 3 = 1 then 60.5::double else 0.0::double end as sec, true as wrong_is_null from orders
""")
def date_parse_forms(spark, d):
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 3 == 0, F.date_format(t, "yyyy-MM-dd")).when((k % 3 == 2) & (F.year(t) < 2000), F.date_format(t, "dd/MM/yy")).when(k % 3 == 1, F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit("T23:59:60.5"))).otherwise(F.date_format(t, "yyyy-MM-dd"))
    rows = table(spark, d, "orders").withColumn("d", times.parse(text)).withColumn("bad", times.parse(F.date_format(t, "yyyy-13-dd")))
    return rows.select("o_orderkey", F.col("d.year").alias("y"), F.col("d.month").alias("m"), F.col("d.day").alias("dd"), F.col("d.second").alias("sec"), F.col("bad").isNull().alias("wrong_is_null"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as iso from orders")
def date_format(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", times.parse(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("d"))
    return rows.select("o_orderkey", times.format_date(F.col("d")).alias("iso"))


_SYSTEMS = ("UTC", "TDT", "et", "TT(TAI)", "GMT", "IAT", "UT", "XYZ")


@query("""
select n_nationkey, t.text, sys as system from nation, (values ('UTC', 'UTC'), ('TDT', 'TT'), ('et', 'TT'), ('TT(TAI)', 'TT'), ('GMT', 'UTC'), ('IAT', 'TAI'), ('UT', 'UT1'), ('XYZ', null)) t(text, sys)
""")
def timesys_synonyms(spark, d):
    forms = F.explode(F.array(*[F.lit(s) for s in _SYSTEMS])).alias("text")
    return table(spark, d, "nation").select("n_nationkey", forms).select("n_nationkey", "text", times.time_system(F.col("text")).alias("system"))


@query("""
select n_nationkey, case n_regionkey when 0 then 2451545.25::double + 0.25 - 2400000.5 when 1 then 51544.0::double when 2 then 50000.0::double + 0.5 when 3 then 49999.0 end as mjdref from nation
""")
def mjdref_precedence(spark, d):
    r = F.col("n_regionkey")
    only = lambda k, v: F.when(r == k, F.lit(v))
    ref = times.mjd_reference(jdi=only(0, 2451545.25), jdf=only(0, 0.25), date=only(1, "2000-01-01"), m=F.when(r.isin(2, 3), F.lit(49999.0)), mi=only(2, 50000.0), mf=only(2, 0.5))
    return table(spark, d, "nation").select("n_nationkey", ref.alias("mjdref"))


def _real(name, form, sql):
    @query(f"select s_suppkey, {sql} as text from supplier", f"tdisp_{name}")
    def run(spark, d):
        return table(spark, d, "supplier").select("s_suppkey", display.render_real(F.col("s_acctbal"), form).alias("text"))


_real("f", "F12.3", "printf('%12.3f', s_acctbal)")
_real("e", "E16.6", "printf('%16.6E', s_acctbal)")
_real("d", "D16.6", "replace(printf('%16.6E', s_acctbal), 'E', 'D')")
_real("es", "ES18.8E3", "lpad(regexp_replace(printf('%.8E', s_acctbal), 'E([+-])(..)$', 'E\\10\\2'), 18, ' ')")
_DECADE = "floor(log10(abs(s_acctbal)))::int"
_real("g", "G14.7", f"lpad(case when s_acctbal = 0 then '0.000000' when {_DECADE} between -1 and 6 then printf('%.*f', 6 - {_DECADE}, s_acctbal) else printf('%.6E', s_acctbal) end, 14, ' ')")
_real("en", "EN16.6", f"lpad(printf('%.6f', s_acctbal / pow(10.0, {_DECADE} - (({_DECADE} % 3) + 3) % 3)) || 'E' || case when {_DECADE} < 0 then '-' else '+' end || lpad((({_DECADE} - (({_DECADE} % 3) + 3) % 3))::varchar, 2, '0'), 16, ' ')")


def _integer(name, form, sql):
    @query(f"select o_orderkey, {sql} as text from orders", f"tdisp_{name}")
    def run(spark, d):
        return table(spark, d, "orders").select("o_orderkey", display.render_integer(F.col("o_orderkey"), form).alias("text"))


_integer("i", "I12.8", "lpad(printf('%08d', o_orderkey), 12, ' ')")
_integer("z", "Z12.6", "lpad(printf('%06X', o_orderkey), 12, ' ')")
_integer("o", "O14", "lpad(printf('%o', o_orderkey), 14, ' ')")
_integer("b", "B40", "lpad(bin(o_orderkey), 40, ' ')")


@query("select n_nationkey, rpad(substr(n_name, 1, 5), 5, ' ') as text from nation")
def tdisp_a(spark, d):
    return table(spark, d, "nation").select("n_nationkey", display.render_text(F.col("n_name"), "A5").alias("text"))


@query("select n_nationkey, lpad(case when n_regionkey = 2 then 'T' else 'F' end, 3, ' ') as text from nation")
def tdisp_l(spark, d):
    return table(spark, d, "nation").select("n_nationkey", display.render_logical(F.col("n_regionkey") == 2, "L3").alias("text"))


@query("select l_orderkey, l_linenumber, ((l_partkey % 100) // 16) + 7 * ((l_suppkey % 50) // 8) as tile from lineitem")
def tile_geometry(spark, d):
    coords = [F.col("l_partkey") % 100, F.col("l_suppkey") % 50]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", arrays.tile_of(coords, [100, 50], [16, 8]).alias("tile"))


@query("""
select o_orderkey // 500 as tile, case when max(o_totalprice) = min(o_totalprice) then 1.0::double else (max(o_totalprice) - min(o_totalprice)) / 100000.0::double end as scale,
  case when max(o_totalprice) = min(o_totalprice) then min(o_totalprice) else (min(o_totalprice) + max(o_totalprice)) / 2.0::double end as zero, false as lossless from orders group by 1
""")
def tile_minmax_quant(spark, d):
    rows = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 500).cast("bigint").alias("tile"), F.col("o_totalprice").alias("v"))
    return tile_ops.quantize_parameters(rows, "tile", "v").select("tile", "scale", "zero", "lossless")


@query("""
with p as (select o_orderkey // 500 as tile, (max(o_totalprice) - min(o_totalprice)) / 100000.0::double as s, (min(o_totalprice) + max(o_totalprice)) / 2.0::double as z from orders group by 1)
select o_orderkey, round((o_totalprice - z) / s)::int as stored, round(round((o_totalprice - z) / s) * s + z, 8) as value from orders join p on tile = o_orderkey // 500
""")
def quantize_roundtrip(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 500).cast("bigint").alias("tile"), F.col("o_totalprice").alias("v"))
    rows = rows.join(tile_ops.quantize_parameters(rows, "tile", "v"), "tile")
    stored = tile_ops.quantize(F.col("v"), F.col("scale"), F.col("zero"))
    return rows.select("o_orderkey", stored.alias("stored"), F.round(tile_ops.unquantize(stored, F.col("scale"), F.col("zero")), 8).alias("value"))


@query("""
with recursive s(n, seed) as (select 1, 16807::bigint union all select n + 1, (seed * 16807) % 2147483647 from s where n < 10000)
select n, seed from s where n % 100 = 0
""")
def dither_sequence(spark, d):
    """Every hundredth seed of the format's random sequence."""
    seeds = codecs.random_seeds().tolist()
    return spark.createDataFrame([(n, seeds[n - 1]) for n in range(100, len(seeds) + 1, 100)], "n int, seed bigint")


def _codec(codec, key, column, of, kind, sql_kind, divisor):
    """Values through encode and decode, tile by tile: lossless, so that they come back."""

    @query(f"select {key}, {column}::{sql_kind} as value from {of}", f"{codec.lower().split('_')[0] if codec != 'GZIP_2' else 'gzip2'}_roundtrip")
    def run(spark, d):
        rows = table(spark, d, of).select(F.col(key), F.floor(F.col(key) / divisor).cast("bigint").alias("tile"), F.expr(column.replace("//", "div")).cast("int").alias("value"))
        return tile_ops.roundtrip(rows, key, "tile", "value", codec, np.dtype(kind)).select(key, F.col("value").cast({"int": "int", "bigint": "bigint"}[sql_kind]).alias("value"))


_codec("RICE_1", "o_orderkey", "o_custkey", "orders", "i4", "int", 500)
_codec("GZIP_1", "o_orderkey", "o_custkey", "orders", "i4", "int", 500)
_codec("GZIP_2", "o_orderkey", "o_custkey", "orders", "i4", "int", 500)
_codec("PLIO_1", "p_partkey", "p_size", "part", "i4", "int", 250)
_codec("HCOMPRESS_1", "o_orderkey", "o_custkey", "orders", "i4", "int", 500)


@query("""
select k as plane, string_agg(substr(lpad(printf('%x', n_nationkey * 1000003), 8, '0'), 1 + 2 * k, 2), '' order by n_nationkey) as bytes
from nation, (select unnest(range(0, 4))::int as k) group by k
""")
def byte_shuffle(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 1000003).cast("int").alias("v"))
    tile = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "v"))), lambda x: x["v"]).alias("v"))

    def planes(frames):
        for batch in frames:
            for v in batch.column(0):
                data = codecs.shuffle(np.array(v.as_py(), ">i4").tobytes(), 4)
                n = len(data) // 4
                yield pa.RecordBatch.from_arrays([pa.array(range(4), pa.int32()), pa.array([data[k * n : k * n + n].hex() for k in range(4)])], ["plane", "bytes"])

    return tile.mapInArrow(planes, "plane int, bytes string")


@query("select l_returnflag, sum(l_partkey)::bigint as total, count(*)::bigint as n from lineitem group by 1")
def iterator_sum(spark, d):
    def add(batch):
        found = pa.Table.from_batches([batch]).group_by("l_returnflag").aggregate([("l_partkey", "sum"), ("l_partkey", "count")])
        return {"l_returnflag": found["l_returnflag"].combine_chunks(), "total": found["l_partkey_sum"].combine_chunks(), "n": found["l_partkey_count"].combine_chunks()}

    rows = work.run(table(spark, d, "lineitem").select("l_returnflag", "l_partkey"), add, "l_returnflag string, total bigint, n bigint")
    return rows.groupBy("l_returnflag").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


@query("select s_suppkey, s_acctbal * 2.0::double as flux, (s_suppkey + 1)::bigint as count from supplier")
def iterator_inout(spark, d):
    def change(batch):
        return {"s_suppkey": batch.column("s_suppkey"), "flux": batch.column("s_acctbal").to_numpy() * 2, "count": batch.column("s_suppkey").to_numpy() + 1}

    return work.run(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), change, "s_suppkey bigint, flux double, count bigint")
