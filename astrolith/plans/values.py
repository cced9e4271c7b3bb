"""Queries of scans, typed values, selection and edits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays, convert, text
from ..operators import edits
from .registry import query, table


@query("""
select l_returnflag, count(*)::bigint as rows_read, count(*) filter (where l_quantity::int <> 13)::bigint as valid,
  round(sum(case when l_quantity::int <> 13 then 100.0::double + 0.5::double * l_quantity::int end), 6) as total,
  round(avg(case when l_quantity::int <> 13 then 100.0::double + 0.5::double * l_quantity::int end), 6) as mean
from lineitem where l_linenumber between 1 and 7 and (l_linenumber - 1) % 3 = 0 group by l_returnflag
""")
def flagship_calibrated_section(spark, d):
    """A strided row section of a table, its raw column calibrated with a null value, summed by flag."""
    raw = F.round("l_quantity").cast("int")
    rows = table(spark, d, "lineitem").filter(arrays.in_section([F.col("l_linenumber")], [1], [7], [3]))
    value = convert.null_if(raw, 13, convert.physical(raw, 0.5, 100.0))
    return rows.select("l_returnflag", value.alias("v")).groupBy("l_returnflag").agg(
        F.count("*").alias("rows_read"), F.count("v").alias("valid"), F.round(F.sum("v"), 6).alias("total"), F.round(F.avg("v"), 6).alias("mean")
    )


@query("select n_nationkey as hdu, n_name as extname from nation where upper(trim(n_name)) = 'FRANCE' or upper(trim(n_name)) = 'NATION_6' order by n_nationkey limit 1")
def hdu_select_by_name(spark, d):
    name = F.upper(F.trim("n_name"))
    rows = table(spark, d, "nation").filter((name == "FRANCE") | (name == "NATION_6"))
    return rows.select(F.col("n_nationkey").alias("hdu"), F.col("n_name").alias("extname")).orderBy("hdu").limit(1)


def _wild(column, of, pattern):
    return lambda spark, d: table(spark, d, of).filter(text.matches(F.col(column), pattern)).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))


query("select p_type as name, count(*)::bigint as n from part where regexp_full_match(p_type, '.*[eE].*') group by 1", "column_wildcard_star")(_wild("p_type", "part", "*e*"))
query("select s_name as name, count(*)::bigint as n from supplier where regexp_full_match(s_name, '(?i)supplier.0000000..') group by 1", "column_wildcard_qmark")(_wild("s_name", "supplier", "SUPPLIER?0000000??"))
query("select c_name as name, count(*)::bigint as n from customer where regexp_full_match(c_name, '(?i)customer.[0-9]+') group by 1", "column_wildcard_hash")(_wild("c_name", "customer", "customer?#"))

PATTERNS = ("n_name", "N_*", "x*", "n_?ame", "*key")


@query("""
with p(pattern, re) as (values ('n_name', 'n_name'), ('N_*', 'n_.*'), ('x*', 'x.*'), ('n_?ame', 'n_.ame'), ('*key', '.*key')),
c(name) as (values ('n_nationkey'), ('n_name'), ('n_regionkey'))
select pattern, count(name)::bigint as found, case count(name) when 0 then 'NoSuchColumn' when 1 then 'one' else 'AmbiguousColumn' end as outcome
from p left join c on regexp_full_match(name, re, 'i') group by pattern
""")
def column_resolve_contract(spark, d):
    names = spark.createDataFrame([(c,) for c in table(spark, d, "nation").columns], "name string")
    patterns = spark.createDataFrame([(p, text.wildcard(p)) for p in PATTERNS], "pattern string, re string")
    rows = patterns.join(names, F.expr("name rlike re"), "left").groupBy("pattern").agg(F.count("name").alias("found"))
    return rows.withColumn("outcome", F.when(F.col("found") == 0, "NoSuchColumn").when(F.col("found") == 1, "one").otherwise("AmbiguousColumn"))


@query("select l_orderkey, l_linenumber, 100.0::double + 2.0::double * l_linenumber as physical from lineitem")
def scale_linear_read(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", convert.physical(F.col("l_linenumber"), 2.0, 100.0).alias("physical"))


@query("select l_orderkey, l_linenumber, round((l_extendedprice - 100.0::double) / 2.0::double)::int as stored from lineitem")
def scale_linear_write_inverse(spark, d):
    stored = convert.stored_value(F.col("l_extendedprice"), 2.0, 100.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", convert.to_integer(stored, "i32").alias("stored"))


def _unsigned(kind):
    def run(spark, d):
        stored = F.col("o_orderkey") % 32768 if kind == "u16" else F.col("o_orderkey")
        return table(spark, d, "orders").select("o_orderkey", convert.unsigned(stored, kind).cast("string").alias("value"))

    return run


query("select o_orderkey, (o_orderkey % 32768 + 32768)::varchar as value from orders", "scale_unsigned_u16")(_unsigned("u16"))
query("select o_orderkey, (o_orderkey + 2147483648)::varchar as value from orders", "scale_unsigned_u32")(_unsigned("u32"))
query("select o_orderkey, (o_orderkey::hugeint + 9223372036854775808::hugeint)::varchar as value from orders", "scale_unsigned_u64")(_unsigned("u64"))


@query("select n_nationkey, case when n_regionkey <> 2 then 1.5::double + 0.25::double * n_regionkey end as value from nation")
def null_blank_substitution(spark, d):
    return table(spark, d, "nation").select("n_nationkey", convert.null_if(F.col("n_regionkey"), 2, convert.physical(F.col("n_regionkey"), 0.25, 1.5)).alias("value"))


@query("select c_custkey, case when c_acctbal < 0 then -1.0::double else c_acctbal end as value from customer")
def null_nan_sentinel(spark, d):
    v = F.when(F.col("c_acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", convert.sentinel(v, -1.0).alias("value"))


@query("select c_custkey, round(c_acctbal)::bigint as whole, round((c_custkey % 9) - 4.5)::int as half from customer")
def cast_round_half_away(spark, d):
    half = (F.col("c_custkey") % 9).cast("double") - 4.5
    return table(spark, d, "customer").select("c_custkey", convert.to_integer(F.col("c_acctbal"), "i64").alias("whole"), convert.to_integer(half, "i32").alias("half"))


@query("""
with v as (select l_orderkey, l_linenumber, case when l_linenumber = 7 then 'NaN'::double else l_extendedprice - 30000 end as x from lineitem)
select l_orderkey, l_linenumber,
  case when isnan(x) then 'NanToInt' when round(x) between -128 and 127 then 'ok' else 'Overflow' end as as_i8,
  case when isnan(x) then 'NanToInt' when round(x) between -32768 and 32767 then 'ok' else 'Overflow' end as as_i16,
  case when isnan(x) then 'NanToInt' when round(x) between 0 and 65535 then 'ok' else 'Overflow' end as as_u16,
  case when isnan(x) then 'NanToInt' else 'ok' end as as_i32
from v
""")
def cast_overflow_class(spark, d):
    x = F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_extendedprice") - 30000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[convert.cast_class(x, k).alias(f"as_{k}") for k in ("i8", "i16", "u16", "i32")])


@query("""
select o_orderkey, o_orderkey % 90000 * 90071992547409 + 1 as value,
  (o_orderkey % 90000 * 90071992547409 + 1)::double::hugeint = (o_orderkey % 90000 * 90071992547409 + 1)::hugeint as exact from orders
""")
def cast_precision_loss_class(spark, d):
    x = F.col("o_orderkey") % F.lit(90000) * F.lit(90071992547409) + 1
    return table(spark, d, "orders").select("o_orderkey", x.alias("value"), convert.exact_as_double(x).alias("exact"))


@query("select s_suppkey, s_suppkey::bigint as id, round(s_acctbal, 2) as flux, s_name as note from supplier")
def ascii_field_slice(spark, d):
    row = F.concat(text.write_field(F.col("s_suppkey").cast("string"), 10), F.lit(" "), text.write_field(F.format_string("%.2f", "s_acctbal"), 14), F.lit(" "), text.write_field(F.col("s_name"), 24, True))
    rows = table(spark, d, "supplier").select("s_suppkey", row.alias("row"))
    return rows.select(
        "s_suppkey", text.parse_integer(text.field(F.col("row"), 1, 10)).alias("id"),
        text.parse_real(text.field(F.col("row"), 12, 14)).alias("flux"), F.rtrim(text.field(F.col("row"), 27, 24)).alias("note"),
    )


@query("select o_orderkey, o_orderkey / 100.0::double as value from orders")
def ascii_implied_decimal(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.parse_real(F.col("o_orderkey").cast("string"), 2).alias("value"))


@query("select p_partkey, (p_size || '.25e' || (p_partkey % 5))::double as value from part")
def ascii_d_exponent(spark, d):
    t = F.concat(F.col("p_size").cast("string"), F.lit(".25D"), (F.col("p_partkey") % 5).cast("string"))
    return table(spark, d, "part").select("p_partkey", text.parse_real(t).alias("value"))


@query("select p_partkey, (p_size || '.5e-' || (p_partkey % 4)::varchar)::double as value from part")
def ascii_bare_exponent(spark, d):
    t = F.concat(F.col("p_size").cast("string"), F.lit(".5-"), (F.col("p_partkey") % 4).cast("string"))
    return table(spark, d, "part").select("p_partkey", text.parse_real(t).alias("value"))


@query("select n_nationkey, case when n_regionkey not in (1, 3) then n_nationkey::bigint end as value from nation")
def ascii_null_fields(spark, d):
    raw = F.when(F.col("n_regionkey") == 1, "      ").when(F.col("n_regionkey") == 3, "  N/A ").otherwise(F.lpad(F.col("n_nationkey").cast("string"), 6, " "))
    return table(spark, d, "nation").select("n_nationkey", F.when(~text.field_null(raw, "  N/A"), text.parse_integer(raw)).alias("value"))


@query("select s_suppkey, printf('%8d', s_suppkey) as id, printf('%14.2f', s_acctbal) as flux, rpad(s_name, 24, ' ') as note from supplier")
def ascii_write_fields(spark, d):
    return table(spark, d, "supplier").select(
        "s_suppkey", text.write_field(F.col("s_suppkey").cast("string"), 8).alias("id"),
        text.write_field(F.format_string("%.2f", "s_acctbal"), 14).alias("flux"), text.write_field(F.col("s_name"), 24, True).alias("note"),
    )


@query("select o_orderkey, case o_orderstatus when 'F' then false when 'O' then true end as value from orders")
def logical_decode(spark, d):
    code = F.when(F.col("o_orderstatus") == "O", "T").when(F.col("o_orderstatus") == "F", "F").otherwise("\0")
    return table(spark, d, "orders").select("o_orderkey", text.logical(code).alias("value"))


@query("select o_orderkey, k, ((o_orderkey & 255) >> (7 - k)) & 1 as bit from orders, (select unnest(range(0, 8))::int as k)")
def bits_unpack(spark, d):
    bits = text.unpack_bits(F.col("o_orderkey").bitwiseAND(F.lit(255)))
    rows = table(spark, d, "orders").select("o_orderkey", F.posexplode(bits).alias("k", "bit"))
    return rows.select("o_orderkey", "k", F.col("bit").cast("bigint").alias("bit"))


@query("select o_orderkey, (o_orderkey & 255)::int as byte from orders")
def bits_pack(spark, d):
    bits = text.unpack_bits(F.col("o_orderkey").bitwiseAND(F.lit(255)))
    return table(spark, d, "orders").select("o_orderkey", text.pack_bits(bits).cast("int").alias("byte"))


@query("select c_custkey, case when c_custkey % 7 = 0 then null else rpad(substr(c_name, 1, 12), 20, ' ') end as value from customer")
def char_nul_pad(spark, d):
    raw = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("\0"), F.col("c_name"))).otherwise(F.concat(F.substring("c_name", 1, 12), F.lit("\0junk")))
    return table(spark, d, "customer").select("c_custkey", text.characters(raw, 20).alias("value"))


@query("select c_custkey, k, rtrim(substr(c_name, 1 + k * 6, 6)) as piece from customer, (select unnest(range(0, 3))::int as k)")
def char_tdim_split(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.posexplode(text.substrings(F.col("c_name"), 6, 3)).alias("k", "piece"))


@query("""
select vec_id, k, round(sqrt(embedding[2 * k + 1]::double ** 2 + embedding[2 * k + 2]::double ** 2), 9) as modulus
from embeddings, (select unnest(range(0, 32))::int as k)
""")
def complex_pairs(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(text.complex_pairs(F.col("embedding").cast("array<double>"))).alias("k", "z"))
    return rows.select("vec_id", "k", F.round(F.sqrt(F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")), 9).alias("modulus"))


@query("select vec_id, generate_subscripts(embedding, 1)::int - 1 as k, unnest(embedding)::double as value from embeddings")
def vla_explode(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "value"))
    return rows


@query("select doc_id, len(string_split(text, ' '))::int as n from documents")
def vla_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", " ")).alias("n"))


@query("select conv_id, turn, (sum(len(string_split(text, ' '))) over (partition by conv_id order by turn) - len(string_split(text, ' ')))::bigint as heap_offset from conversations")
def vla_heap_offsets(spark, d):
    n = F.size(F.split("text", " "))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", (F.sum(n).over(w) - n).cast("bigint").alias("heap_offset"))


@query("""
select conv_id, turn, case when turn % 3 <> 1 then (sum(n) over (partition by conv_id order by turn) - n)::bigint end as new_offset
from (select conv_id, turn, case when turn % 3 <> 1 then len(string_split(text, ' ')) else 0 end as n from conversations)
""")
def heap_compact(spark, d):
    """Every third cell is freed: it has no place any more, and those after it move up."""
    live = F.col("turn") % 3 != 1
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(live, F.size(F.split("text", " "))).otherwise(0).cast("bigint").alias("n"))
    return edits.compact(rows, "n", "turn", ["conv_id"]).select("conv_id", "turn", F.when(live, F.col("new_offset")).alias("new_offset"))


@query("""
select v as row_no, k as axis1, embedding[k + 1]::double as value, ((v - 2) // 5) * 16 + (k - 1) // 4 as out_index
from (select vec_id as v, embedding, unnest(range(0, 64)) as k from embeddings) where v >= 2 and (v - 2) % 5 = 0 and k between 1 and 62 and (k - 1) % 4 = 0
""")
def image_section_strided(spark, d):
    """A section whose second axis is open-ended: it goes on to the image's last row."""
    rows = table(spark, d, "embeddings")
    last = rows.agg(F.max("vec_id")).first()[0]
    low, high, step = [1, 2], [62, max(2, last or 0)], [4, 5]
    rows = rows.filter(arrays.in_section([F.col("vec_id")], low[1:], high[1:], step[1:]))
    rows = rows.select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "value"))
    coords = [F.col("k").cast("bigint"), F.col("vec_id")]
    rows = rows.filter(arrays.in_section(coords, low, high, step))
    return rows.select(F.col("vec_id").alias("row_no"), coords[0].alias("axis1"), "value", arrays.section_index(coords, low, high, step).alias("out_index"))


@query("select l_orderkey, l_linenumber, (l_partkey % 100) + 100 * (l_suppkey % 50) + 5000 * (l_linenumber - 1) as pix from lineitem")
def image_linear_index(spark, d):
    coords = [F.col("l_partkey") % 100, F.col("l_suppkey") % 50, F.col("l_linenumber") - 1]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", arrays.linear_index(coords, [100, 50, 7]).alias("pix"))


@query("select o_orderkey, o_orderkey % 30 as c1, (o_orderkey // 30) % 20 as c2, (o_orderkey // 600) % 1000 as c3 from orders")
def image_unravel(spark, d):
    c = arrays.unravel(F.col("o_orderkey"), [30, 20, 1000])
    return table(spark, d, "orders").select("o_orderkey", *[x.alias(f"c{i + 1}") for i, x in enumerate(c)])


@query("""
select o_orderkey as pix, case when o_orderkey % 2 = 0 and o_orderkey between 100 and 2000 then -1.0::double else o_totalprice end as value from orders
""")
def image_section_write_overlay(spark, d):
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("pix"), F.col("o_totalprice").alias("value"))
    new = base.filter(arrays.in_section([F.col("pix")], [100], [2000], [2])).select("pix", F.lit(-1.0).alias("value"))
    return arrays.overlay(base, new, "pix", "value").select("pix", "value")


@query("""
select i as pix, i % 8 as c1, i // 8 as c2, coalesce(n_regionkey, 0)::int as value
from (select unnest(range(0, 40)) as i) left join nation on n_nationkey = i
""")
def image_reshape(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("pix"), F.col("n_regionkey").alias("value"))
    rows = arrays.reshape(rows, "pix", "value", 40, 0)
    c = arrays.unravel(F.col("pix"), [8, 5])
    return rows.select("pix", c[0].alias("c1"), c[1].alias("c2"), "value")


def _supplier(spark, d):
    return table(spark, d, "supplier").select((F.col("s_suppkey") - 1).alias("rownum"), "s_nationkey", "s_acctbal")


@query("select s_suppkey - 1 as rownum, s_nationkey, s_acctbal from supplier union all select (select count(*) from supplier) + i, 0, 0.0 from (select unnest(range(0, 5)) as i)")
def rows_append(spark, d):
    rows = _supplier(spark, d)
    return edits.append_rows(rows, "rownum", 5)


@query("select case when s_suppkey - 1 >= 10 then s_suppkey + 2 else s_suppkey - 1 end as rownum, s_nationkey, s_acctbal from supplier union all select 10 + i, 0, 0.0 from (select unnest(range(0, 3)) as i)")
def rows_insert(spark, d):
    return edits.insert_rows(_supplier(spark, d), "rownum", 10, 3)


@query("select case when s_suppkey - 1 >= 24 then s_suppkey - 5 else s_suppkey - 1 end as rownum, s_nationkey, s_acctbal from supplier where s_suppkey - 1 not between 20 and 23")
def rows_delete(spark, d):
    return edits.delete_rows(_supplier(spark, d), "rownum", 20, 4)


@query("""
select a.s_suppkey - 1 as rownum, coalesce(b.s_nationkey, a.s_nationkey) as s_nationkey, coalesce(b.s_acctbal, a.s_acctbal) as s_acctbal
from supplier a left join supplier b on a.s_suppkey - 1 between 3 and 12 and b.s_suppkey - 1 = a.s_suppkey - 1 - 3 + 5
""")
def rows_copy(spark, d):
    return edits.copy_rows(_supplier(spark, d), "rownum", 5, 10, 3)


@query("select n_nationkey, n_name, n_regionkey, 0.0::double as flux from nation")
def cols_append(spark, d):
    return edits.insert_column(table(spark, d, "nation"), "flux", F.lit(0.0), 3)


@query("select n_nationkey, 0 as flag, n_name, n_regionkey from nation")
def cols_insert(spark, d):
    return edits.insert_column(table(spark, d, "nation"), "flag", F.lit(0), 1)


@query("select n_nationkey, n_name from nation")
def cols_delete(spark, d):
    return edits.delete_column(table(spark, d, "nation"), "N_REGION*")


@query("select n_regionkey as n_nationkey, n_name, n_regionkey from nation")
def cols_copy(spark, d):
    return edits.copy_column(table(spark, d, "nation"), "n_regionkey", "n_nationkey")
