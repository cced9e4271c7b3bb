"""Shards by extendible hashing.

A document's hash is the first 60 bits of the md5 of its id as text.  The directory is indexed by
hash-prefix bits.  A bucket above the byte limit splits on its next bit, and only such buckets do,
until every one fits.  Split buckets are found from sums of bytes over prefixes, ``STEP`` more bits
in each round, and only for the buckets that are still too large, so no bucket's rows are gathered.

Defined cases: a null text has no bytes; null ids hash as the empty text; a document larger than the
limit cannot be split: it, and what shares all 60 bits with it (rows that repeat an id), is dealt on
into pages, numbered from 0, each filled up in order of size inside a run of rows, with a page of its
own for what is too large; an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ROW_BYTES, written

#: Bits of the hash, and bits that a round adds.
BITS, STEP = 60, 12
#: A task pages about so many pages' bytes of a shard that cannot be split.
RUN_PAGES = 64


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the md5 of the id as text, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """(prefix, depth, bytes, documents) of every shard; sizes has h (the hash) and bytes.

    Each round takes the open prefixes of ``depth`` bits, sums up bytes by ``depth + STEP`` bits, and
    finds for each sum the shallowest prefix that fits.  Sums are small next to the documents, and
    each round is written.
    """
    shards, open_, depth = None, None, 0
    while depth < BITS:
        deep = min(BITS, depth + STEP)
        rows = sizes
        if open_ is not None:
            rows = rows.withColumn("p", F.shiftright("h", BITS - depth)).join(open_, "p", "left_semi")
        leaf = rows.groupBy(F.shiftright("h", BITS - deep).alias("q")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("documents"))
        leaf = written(leaf, "leaves")
        levels = leaf.select("q", "bytes", "documents", F.explode(F.sequence(F.lit(depth if depth == 0 else depth + 1), F.lit(deep))).alias("d"))
        levels = levels.groupBy("d", F.call_function("shiftright", F.col("q"), F.lit(deep) - F.col("d")).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("documents").alias("documents"))
        levels = written(levels, "levels")
        fits = levels.filter(F.col("bytes") <= limit)
        # A prefix is a shard if it fits and its parent does not.
        large = levels.filter(F.col("bytes") > limit).select((F.col("d") + 1).alias("d"), F.col("prefix").alias("parent"))
        top = depth if depth == 0 else depth + 1
        own = fits.withColumn("parent", F.shiftright("prefix", 1)).join(large, ["d", "parent"], "left_semi")
        own = own.unionByName(fits.filter(F.col("d") == top).withColumn("parent", F.shiftright("prefix", 1))).dropDuplicates(["d", "prefix"])
        own = own.select("prefix", F.col("d").alias("depth"), "bytes", "documents")
        shards = own if shards is None else shards.unionByName(own)
        open_ = written(levels.filter((F.col("d") == deep) & (F.col("bytes") > limit)).select(F.col("prefix").alias("p")), "open")
        if open_.isEmpty():
            break
        depth = deep
    if not open_.isEmpty():
        rest = levels.filter((F.col("d") == BITS) & (F.col("bytes") > limit))
        shards = shards.unionByName(rest.select("prefix", F.col("d").alias("depth"), "bytes", "documents"))
    return written(shards, "directory")


def _sizes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, bytes, n): a row per document, numbered."""
    rows = docs.select(F.col(key).alias("id"), hash_bits(F.col(key)).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"))
    return written(rows.withColumn("n", F.monotonically_increasing_id()), "sizes")


def _found(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """rows (with h) with shard, depth and shard_bytes, from one lookup of the prefix of each depth that the directory has.

    Depths are few, and the directory is broadcast only if it is small.
    """
    depths = sorted(r["depth"] for r in shards.select("depth").distinct().collect())  # 61 at most
    if not depths:
        return rows.select("*", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("shard_bytes")).limit(0)
    few = shards.count() * ROW_BYTES <= BROADCAST_BYTES
    own = shards.select("depth", "prefix", F.col("bytes").alias("shard_bytes"))
    rows = rows.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    rows = rows.withColumn("prefix", F.call_function("shiftright", F.col("h"), F.lit(BITS) - F.col("depth")))
    rows = rows.join(F.broadcast(own) if few else own.hint("merge"), ["depth", "prefix"])
    name = F.when(F.col("depth") > 0, F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).otherwise("")
    return rows.withColumn("shard", name).drop("prefix")


def _paged(over: DataFrame, limit: int) -> DataFrame:
    """(n, page) of the rows (n, bytes, shard, shard_bytes) of shards above the limit, which cannot be split.

    A shard's rows are dealt by number into runs of about RUN_PAGES pages, so that no task holds a
    large shard; running sums fill pages inside a run, and runs are numbered one after the other.
    """
    runs = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("shard_bytes") / (limit * RUN_PAGES)))
    rows = over.select("n", "bytes", "shard", F.pmod(F.xxhash64("n"), runs).alias("run"))
    small = F.col("bytes") * 2 <= limit
    by = Window.partitionBy("shard", "run")
    order = by.orderBy("bytes", "n")
    before = F.sum(F.when(small, F.col("bytes"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("bytes")
    # Half the limit for each step of the running sum: two neighbours never exceed it together.
    rows = rows.withColumn("page", F.when(small, F.floor(before * 2 / limit)))
    rows = rows.withColumn("wide", F.sum(F.when(small, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.coalesce(F.max("page").over(by) + 1, F.lit(0))
    rows = rows.withColumn("page", F.coalesce("page", first + F.col("wide") - 1).cast("bigint"))
    rows = written(rows.select("n", "shard", "run", "page"), "paged")
    # A row for each run: a shard's runs hold RUN_PAGES pages each, so they are few.
    ends = rows.groupBy("shard", "run").agg((F.max("page") + 1).alias("pages"))
    ends = ends.withColumn("base", F.sum("pages").over(Window.partitionBy("shard").orderBy("run")) - F.col("pages"))
    return rows.join(ends.drop("pages"), ["shard", "run"]).select("n", (F.col("page") + F.col("base")).cast("int").alias("page"))


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, bytes, shard, depth, page) for each row; shard is the prefix in bits, "" for the whole."""
    sizes = _sizes(docs, key, text)
    rows = _found(sizes, directory(sizes, limit))
    over = written(rows.filter(F.col("shard_bytes") > limit), "overfull")
    out = rows.filter(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0))
    if not over.isEmpty():
        out = out.unionByName(over.join(_paged(over, limit), "n").select(*out.columns))
    return out.select(F.col("id").alias(key), "bytes", "shard", "depth", "page")


def write_shards(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """docs as Parquet under path, a folder for each shard (x and its bits) and page.

    The folders' columns are ``shard`` and ``page``, with underscores after them if docs has such columns.
    """
    folders = []
    for name in ("shard", "page"):
        while name in docs.columns:
            name += "_"
        folders.append(name)
    sizes = _sizes(docs, key, text)
    where = _found(sizes.groupBy("h").agg(F.count("*").alias("n")).drop("n"), directory(sizes, limit))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), hash_bits(F.col(key)).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"))
    rows = rows.join(written(where, "where"), "h")
    fits = rows.filter(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0))
    # Rows of shards that cannot be split are numbered as they are written, each as often as it is there.
    over = written(rows.filter(F.col("shard_bytes") > limit).withColumn("n", F.monotonically_increasing_id()), "overfull")
    if not over.isEmpty():
        fits = fits.unionByName(over.join(_paged(over, limit), "n").drop("n"))
    out = fits.select("row.*", F.concat(F.lit("x"), "shard").alias(folders[0]), F.col("page").alias(folders[1]))
    out.repartition(*folders).write.partitionBy(*folders).parquet(path)


#: The limit of a shard in the query.
LIMIT = 1 << 20


def op5(spark, sf_dir: str) -> DataFrame:
    """doc_id, bytes, shard, depth and page of every document, in shards of at most one MiB of text."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), LIMIT)


OP5_SQL = f"""
with s as (
  select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as h, coalesce(strlen(text), 0)::bigint as bytes from documents
), t as (
  select d.d, s.h >> (60 - d.d) as p, sum(s.bytes) as n from s cross join (select unnest(range(0, 25))::int as d) d group by all
), m as (
  select s.doc_id, s.bytes, s.h, min(t.d) as depth from s join t on t.p = s.h >> (60 - t.d) where t.n <= {LIMIT} group by all
)
select doc_id, bytes, case when depth = 0 then '' else right(lpad(bin(h), 60, '0'), 60)[1:depth] end as shard, depth, 0 as page from m
"""
