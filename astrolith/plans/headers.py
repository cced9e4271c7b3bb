"""Queries of header cards, checksums, validation and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cards, checksum
from ..operators import grouping, validate
from ..sources import schema
from ..sources.filespec import parse as parse_spec
from .registry import query, table


def _nation_cards(spark, d):
    """Four cards for each nation."""
    n = table(spark, d, "nation")
    lines = F.array(
        cards.build(F.lit("OBJECT"), cards.quote(F.col("n_name")), F.lit("[m/s] the nation")),
        cards.build(F.lit("REGION"), cards.format_integer(F.col("n_regionkey")), F.lit("a key")),
        cards.build(F.lit("RATIO"), F.lpad(F.concat(F.col("n_nationkey").cast("string"), F.lit(".5D0")), 20, " ")),
        F.rpad(F.concat(F.lit("COMMENT nation "), F.col("n_nationkey").cast("string")), 80, " "),
        cards.build(F.lit("INEUROPE"), cards.format_logical(F.col("n_regionkey") == 3)),
    )
    return n.select("n_nationkey", F.posexplode(lines).alias("idx", "raw"))


@query("""
select n_nationkey as hdu, i as idx, ['OBJECT', 'REGION', 'RATIO', 'COMMENT', 'INEUROPE'][i + 1] as name,
  ['string', 'int', 'float', null, 'logical'][i + 1] as value_type,
  case when i = 0 then n_name end as v_str, case when i = 1 then n_regionkey::bigint end as v_int,
  case when i = 2 then n_nationkey + 0.5::double when i = 1 then n_regionkey::double end as v_float, case when i = 4 then n_regionkey = 3 end as v_bool
from nation, (select unnest(range(0, 5))::int as i)
""")
def cards_parse(spark, d):
    rows = _nation_cards(spark, d)
    field, valued = cards.value_field(F.col("raw")), cards.kind(F.col("raw")) == "value"
    of = lambda c: F.when(valued, c)
    return rows.select(
        F.col("n_nationkey").alias("hdu"), "idx", cards.name(F.col("raw")).alias("name"), of(cards.value_type(field)).alias("value_type"),
        of(cards.string_value(field)).alias("v_str"), of(cards.integer_value(field)).alias("v_int"), of(cards.real_value(field)).alias("v_float"), of(cards.logical_value(field)).alias("v_bool"),
    )


@query("select k as kind, n * (select count(*) from nation)::bigint as n from (values ('value', 4), ('commentary', 1)) t(k, n)")
def cards_classify(spark, d):
    return _nation_cards(spark, d).groupBy(cards.kind(F.col("raw")).alias("kind")).agg(F.count("*").alias("n"))


@query("select p_partkey, p_name || ' ''' || p_brand || '''' as value from part")
def card_string_escape(spark, d):
    text = F.concat("p_name", F.lit(" '"), "p_brand", F.lit("'"))
    return table(spark, d, "part").select("p_partkey", cards.string_value(F.concat(cards.quote(text), F.lit(" / x"))).alias("value"))


@query("select p_partkey, p_brand as unit from part")
def card_units(spark, d):
    raw = cards.build(F.lit("SIZE"), cards.format_integer(F.col("p_size")), F.concat(F.lit("["), F.col("p_brand"), F.lit("] size")))
    return table(spark, d, "part").select("p_partkey", cards.unit(cards.comment(cards.value_field(raw))).alias("unit"))


@query("select p_partkey, 'of type ' || p_type as remark from part")
def card_comment(spark, d):
    raw = cards.build(F.lit("BRAND"), cards.quote(F.col("p_brand")), F.concat(F.lit("of type "), F.col("p_type")))
    return table(spark, d, "part").select("p_partkey", cards.comment(cards.value_field(raw)).alias("remark"))


@query("select p_partkey, rpad('PSIZE   = ' || lpad(p_size::varchar, 20, ' ') || ' / ' || p_type, 80, ' ') as card from part")
def card_build(spark, d):
    return table(spark, d, "part").select("p_partkey", cards.build(F.lit("PSIZE"), cards.format_integer(F.col("p_size")), F.col("p_type")).alias("card"))


@query("""
select doc_id, i::bigint as piece, substr(text, 1 + 67 * (i - 1), 67) || case when i < greatest(1, ceil(length(text) / 67.0)) then '&' else '' end as chunk
from (select doc_id, text, unnest(range(1, greatest(1, ceil(length(text) / 67.0))::bigint + 1)) as i from documents)
""")
def continue_split(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(cards.split_long(F.col("text"))).alias("piece", "chunk"))
    return rows.select("doc_id", (F.col("piece") + 1).cast("bigint").alias("piece"), "chunk")


@query("select doc_id, text from documents")
def continue_assemble(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(cards.split_long(F.col("text"))).alias("idx", "chunk"))
    rows = rows.withColumn("base", F.col("idx") == 0)
    return cards.assemble(rows, ["doc_id"], "idx", "base", "chunk").select("doc_id", F.col("chunk").alias("text"))


@query("select p_partkey, upper(p_name) as name, true as same from part")
def hierarch_match(spark, d):
    raw = F.concat(F.lit("HIERARCH "), F.replace(F.upper("p_name"), F.lit(" "), F.lit("  ")), F.lit(" = 1"))
    name = cards.hierarch_name(raw)
    return table(spark, d, "part").select("p_partkey", name.alias("name"), cards.same_hierarch(name, F.concat(F.lit("hierarch "), F.col("p_name"))).alias("same"))


@query("""
select n_nationkey as hdu, k as name, case when k = 'OBSERVER' and n_nationkey % 2 = 0 then n_name when k = 'OBSERVER' then r_name when k = 'TELESCOP' then 'T' || n_regionkey end as value
from nation join region on r_regionkey = 0, (values ('OBSERVER'), ('TELESCOP'), ('BITPIX')) t(k)
""")
def header_inherit(spark, d):
    nation = table(spark, d, "nation")
    names = F.explode(F.array(F.lit("OBSERVER"), F.lit("TELESCOP"), F.lit("BITPIX"))).alias("name")
    wanted = nation.select(F.col("n_nationkey").alias("hdu"), names)
    own = nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("hdu"), F.lit("OBSERVER").alias("name"), F.col("n_name").alias("value"))
    own = own.unionByName(nation.select(F.col("n_nationkey").alias("hdu"), F.lit("TELESCOP").alias("name"), F.concat(F.lit("T"), F.col("n_regionkey")).alias("value")))
    region = table(spark, d, "region").filter("r_regionkey = 0")
    primary = region.select(F.lit("OBSERVER").alias("name"), F.col("r_name").alias("value")).unionByName(region.select(F.lit("BITPIX").alias("name"), F.lit("8").alias("value")))
    return cards.inherit(own, primary, wanted)


@query("select n_regionkey as hdu, arg_min(n_name, n_nationkey) as value from nation group by 1")
def header_first_wins(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("hdu"), F.col("n_name").alias("value"), "n_nationkey")
    return cards.first_of(rows, ["hdu"], "value", "n_nationkey")


SPECS = ("a.fits", "a.fits[0]", "a.fits[SCI]", "a.fits[SCI,2]", "a.fits[1][1:10:2,*]", "a.fits[col X>5]", "a.fits[]", "[1]", "a.fits[1][2]", "a.fits[0:5]")


@query("""
select * from (values
  ('a.fits', null::bigint, null, null::bigint, null, null), ('a.fits[0]', 1, null, null, null, null), ('a.fits[SCI]', null, 'SCI', null, null, null),
  ('a.fits[SCI,2]', null, 'SCI', 2, null, null), ('a.fits[1][1:10:2,*]', 2, null, null, '0:9:2,0:*:1', null), ('a.fits[col X>5]', null, null, null, null, 'UnsupportedFilter'),
  ('a.fits[]', null, null, null, null, 'EmptyBracket'), ('[1]', null, null, null, null, 'EmptyPath'), ('a.fits[1][2]', null, null, null, null, 'DuplicateSelector'),
  ('a.fits[0:5]', null, null, null, null, 'BadSection')) t(spec, hdu, extname, extver, section, error)
""")
def extname_filename_parse(spark, d):
    from ..errors import FitsError

    rows = []
    for s in SPECS:
        try:
            f = parse_spec(s)
            cut = ",".join(f"{a}:{'*' if b is None else b}:{c}" for a, b, c in f.section) if f.section else None
            rows.append((s, f.hdu, f.extname, f.extver, cut, None))
        except FitsError as e:
            rows.append((s, None, None, None, None, type(e).__name__))
    return spark.createDataFrame(rows, "spec string, hdu bigint, extname string, extver bigint, section string, error string")


_FOLD = """
with s as (select {by} sum(({w}) >> 16)::bigint as hi, sum(({w}) & 65535)::bigint as lo from {of}),
a as (select *, (hi & 65535) + (lo >> 16) as h1, (lo & 65535) + (hi >> 16) as l1 from s),
b as (select *, (h1 & 65535) + (l1 >> 16) as h2, (l1 & 65535) + (h1 >> 16) as l2 from a),
c as (select *, (h2 & 65535) + (l2 >> 16) as h3, (l2 & 65535) + (h2 >> 16) as l3 from b)
"""


@query(_FOLD.format(by="", w="(o_orderkey * 2654435761) % 4294967296", of="orders") + "select ((h3 & 65535) + (l3 >> 16)) * 65536 + (l3 & 65535) + (h3 >> 16) as datasum from c")
def checksum_datasum(spark, d):
    return table(spark, d, "orders").agg(checksum.sum_words((F.col("o_orderkey") * 2654435761) % 4294967296).alias("datasum"))


@query(_FOLD.format(by="l_returnflag as hdu,", w="(l_partkey * 2654435761) % 4294967296", of="lineitem group by 1") + "select hdu, ((h3 & 65535) + (l3 >> 16)) * 65536 + (l3 & 65535) + (h3 >> 16) as datasum from c")
def checksum_by_group(spark, d):
    w = (F.col("l_partkey") * 2654435761) % 4294967296
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("hdu")).agg(checksum.sum_words(w).alias("datasum"))


@query(_FOLD.format(by="o_orderstatus as hdu,", w="(o_custkey * 40503) % 4294967296", of="orders group by 1") + """
select hdu, case hdu when 'F' then 'match' when 'O' then 'mismatch' else 'not_present' end as outcome from c
""")
def checksum_verify(spark, d):
    sums = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("hdu")).agg(checksum.sum_words((F.col("o_custkey") * 40503) % 4294967296).alias("s"))
    wanted = F.when(F.col("hdu") == "F", F.col("s")).when(F.col("hdu") == "O", F.col("s") + 1)
    return sums.select("hdu", checksum.status(F.col("s"), wanted).alias("outcome"))


@query("select o_orderkey, (o_orderkey * 2654435761) % 4294967296 as value, true as round_trip, true as plain from orders")
def checksum_encode(spark, d):
    value = (F.col("o_orderkey") * 2654435761) % 4294967296
    text = checksum.encode(value)
    turned = F.concat(F.substring(text, 2, 15), F.substring(text, 1, 1))
    code = lambda k: F.ascii(F.substring(turned, k + 1, 1)) - 48
    back = sum((F.pmod(sum((code(4 * j + i) for j in range(4)), F.lit(0)), F.lit(256)).cast("bigint") * F.lit(1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("bigint"))
    return table(spark, d, "orders").select("o_orderkey", value.alias("value"), (back == value).alias("round_trip"), text.rlike("^[0-9A-Za-z]{16}$").alias("plain"))


def _catalog(spark, d):
    """A catalog of HDUs made of parts: some break rules."""
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("hdu"), F.when(F.col("p_size") % 7 == 0, 7).otherwise(16).alias("bitpix"), F.lit(2).alias("naxis"),
        F.when(F.col("p_size") % 5 == 0, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("gcount"), F.when(F.col("p_size") % 3 == 0, F.lit(4)).otherwise(F.lit(0)).cast("bigint").alias("pcount"),
        F.lit("image").alias("kind"), (F.col("p_size") % 11 == 0).alias("blank"),
    )


@query("""
select hdu, severity, kw from (
  select p_partkey as hdu, 'err' as severity, 'BITPIX' as kw from part where p_size % 7 = 0 union all
  select p_partkey, 'err', 'GCOUNT' from part where p_size % 5 = 0 union all
  select p_partkey, 'warning', 'PCOUNT' from part where p_size % 3 = 0 union all
  select p_partkey, 'warning', 'GCOUNT' from part where p_size % 5 = 0 union all
  select p_partkey, 'err', 'BLANK' from part where false)
""")
def validate_findings(spark, d):
    return validate.image_rules(_catalog(spark, d)).select("hdu", "severity", "kw")


@query("""
select n_regionkey as hdu, name as kw, case when name = 'NAXIS' then 'err' else 'warning' end as severity, count(*)::bigint as n
from (select n_regionkey, case when n_nationkey % 3 = 0 then 'NAXIS' when n_nationkey % 3 = 1 then 'OBJECT' || (n_nationkey % 2) else 'COMMENT' end as name from nation)
where name <> 'COMMENT' group by all having count(*) > 1
""")
def validate_duplicates(spark, d):
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, "NAXIS").when(k % 3 == 1, F.concat(F.lit("OBJECT"), (k % 2).cast("string"))).otherwise("COMMENT")
    return validate.duplicates(table(spark, d, "nation").select(F.col("n_regionkey").alias("hdu"), name.alias("name")))


@query("""
select l_suppkey as hdu, sum(l_linenumber * 4)::bigint as width, (sum(l_linenumber * 4) = 4 * sum(l_linenumber) and l_suppkey % 2 = 0) as ok from lineitem group by l_suppkey
""")
def validate_widths(spark, d):
    fields = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("hdu"), F.concat(F.col("l_linenumber").cast("string"), F.lit("J")).alias("tform"))
    wanted = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("hdu")).agg((4 * F.sum("l_linenumber") + F.max(F.col("l_suppkey") % 2)).alias("naxis1"))
    return validate.widths(fields, wanted).select("hdu", "width", "ok")


FORMS = ("1J", "8A", "E", "3D", "12X", "1PE(40)", "Q", "0I", "3G", "16L")


@query("""
select n_nationkey, form, repeat, code, width from nation, (values
 ('1J', 1::bigint, 'J', 4::bigint), ('8A', 8, 'A', 8), ('E', 1, 'E', 4), ('3D', 3, 'D', 24), ('12X', 12, 'X', 2),
 ('1PE(40)', 1, 'P', 8), ('Q', 1, 'Q', 16), ('0I', 0, 'I', 0), ('3G', null, null, null), ('16L', 16, 'L', 16)) t(form, repeat, code, width)
""")
def tforms_parse(spark, d):
    forms = spark.createDataFrame([(f,) for f in FORMS], "form string")
    rows = table(spark, d, "nation").select("n_nationkey").crossJoin(F.broadcast(forms))
    return rows.select("n_nationkey", "form", *[c.alias(n) for n, c in schema.tform_columns(F.col("form")).items()])


@query("""
select n_nationkey as row_no, case when n_nationkey % 4 = 3 then null when n_nationkey % 2 = 0 then n_regionkey else r_regionkey end as member
from nation left join region on r_name = (select r_name from region where r_regionkey = n_regionkey)
""")
def group_members_resolve(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    rows = n.select(
        k.alias("row_no"), F.when(k % 4 == 3, "http://x").alias("location"), F.when(k % 2 == 0, F.col("n_regionkey") + 1).alias("position"),
        F.lower("r_name").alias("name"), F.lit(None).cast("int").alias("version"),
    )
    catalog = table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("hdu"), F.col("r_name").alias("extname"), F.lit(1).alias("extver"))
    return grouping.resolve(rows, catalog).select("row_no", (F.col("hdu") - 1).alias("member"))


@query("select n_nationkey as hdu, case when n_nationkey % 3 <> 0 and n_regionkey > 0 then r_name end as group_name from nation left join region on r_regionkey = n_regionkey - 1")
def group_links(spark, d):
    n = table(spark, d, "nation")
    links = n.select(F.col("n_nationkey").alias("hdu"), F.col("n_regionkey").alias("grpid"), F.when(F.col("n_nationkey") % 3 == 0, "file:x").alias("grplc"))
    catalog = table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("hdu"), F.col("r_name").alias("extname"))
    return grouping.links(links, catalog).select("hdu", F.col("extname").alias("group_name"))


@query("""
with used as (select n_regionkey as hdu, list(n_nationkey % 7 + 1) as ids from nation where n_nationkey % 5 <> 0 group by 1)
select hdu, (select min(i) from (select unnest(range(1, 1000)) as i) where not list_contains(ids, i))::int as next_id, len(list_distinct(ids))::int as members from used
""")
def group_add_remove(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("hdu"), (F.col("n_nationkey") % 7 + 1).cast("int").alias("id"), (F.col("n_nationkey") % 5 == 0).alias("gone"))
    kept = rows.join(rows.filter("gone"), ["hdu", "id", "gone"], "left_anti")
    return grouping.next_free(kept, "hdu", "id").select("hdu", "next_id", "members")


@query("""
select o_custkey as grp, count(*)::int as n, round(2.0::double * sum(o_totalprice) + 1.0::double, 6) as param, list(o_totalprice order by o_orderkey)[1] as first_value
from orders group by o_custkey
""")
def random_groups_params(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(
        F.sum("o_totalprice").alias("stored"), F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("data")
    )
    from ..functions.convert import physical

    return rows.select("grp", F.size("data").alias("n"), F.round(physical(F.col("stored"), 2.0, 1.0), 6).alias("param"), F.col("data")[0]["o_totalprice"].alias("first_value"))
