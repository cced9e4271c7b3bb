"""WARC records in a content-addressed archive.

An archive is a folder with two tables.  ``payloads`` has each distinct payload once, under its
SHA-256, which is verified when it is read.  ``records`` has the exact header bytes of every record
and the digest of its payload.  Joining both gives the original records.  Of records with equal
payloads of at least ``least`` bytes, the one with the smallest id is the response and the others
are revisits, which have no block of their own; smaller ones are all responses.  ``export`` writes
the records as plain WARC/1.1 files through Spark's text writer, and ``load`` reads such files.

Defined cases: a null payload is empty; a null url has no target header; line ends in a url are
percent-encoded; rows with a null id are revisits if some row of the same payload has an id, else
responses; rows that repeat an id and its payload are responses each, their payload is stored once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ROW_BYTES, forget, lean, scratch_path, written

END = "\r\n"
#: Records in a WARC file, which is read as a whole.
FILE_RECORDS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 in upper-case base32: 20 bits at a time, each to four digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _field(name: str, value: Column) -> Column:
    """A header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = 0) -> None:
    """Write the archive of pages to path."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("payload"))
    known = written(
        rows.select("id", "url", F.unhex(F.sha2("payload", 256)).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").alias("n")), "digests"
    )
    groups = known.filter(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("times"))
    groups = written(groups.filter("times > 1").drop("times"), "repeated")
    big = F.col("n") >= least
    linked = known.join(groups.withColumn("found", F.lit(True)), "digest", "left")
    again = F.coalesce(F.col("found") & big & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1" + END),
        _field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _field("WARC-Record-ID", name(F.col("id"))),
        _field("WARC-Target-URI", target),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Refers-To", F.when(again, name(F.col("first")))),
        _field("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit(END),
    )
    records = linked.select(header.cast("binary").alias("header"), "digest", again.alias("revisit"), "id")
    records.drop("id").write.option("compression", "zstd").parquet(f"{path}/records")
    firsts = written(groups.select("digest"), "repeated-digests")
    keep = rows.select(F.unhex(F.sha2("payload", 256)).alias("digest"), "payload")
    # One of each payload, picked before bytes are shuffled: each task sends one copy at most.
    pick = lambda df: df.groupBy("digest").agg(F.first("payload").alias("payload"))
    if firsts.count() * ROW_BYTES <= BROADCAST_BYTES:
        repeats = pick(keep.join(F.broadcast(firsts), "digest", "left_semi"))
        single = keep.join(F.broadcast(firsts), "digest", "left_anti")
        # Payloads too small to be revisited may repeat too.
        small = [pick(single.filter(F.length("payload") < least))] if least else []
        stored = single.filter(F.length("payload") >= least) if least else single
        for more in (repeats, *small):
            stored = stored.unionByName(more)
    else:
        stored = pick(keep)
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    forget(known, groups, firsts)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(header, revisit, payload) of every record; a payload that does not fit its digest is an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    good = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    stored = stored.select("digest", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("payload does not fit its digest")).cast("binary")).alias("payload"))
    return spark.read.parquet(f"{path}/records").join(stored, "digest").select("header", "revisit", "payload")


def header_field(header: Column, name: str) -> Column:
    """The value of a header line; null where there is none."""
    found = F.regexp_extract(header.cast("string"), f"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def export(spark: SparkSession, path: str, out: str, compression: str = "none") -> None:
    """The archive at path as WARC files in the folder out, at most FILE_RECORDS records in a file."""
    block = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    lines = records(spark, path).select(F.concat("header", block).cast("string").alias("value"))
    lines.write.option("lineSep", END + END).option("maxRecordsPerFile", FILE_RECORDS).option("compression", compression).text(out)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(header, block) of each record in the WARC files under path; a file is read as a whole."""

    def batches(frames):
        import gzip
        import re

        import pyarrow as pa

        length = re.compile(rb"\r\ncontent-length: *(\d+)\r\n", re.I)
        for batch in frames:
            for content in batch.column(0).to_pylist():
                content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                at, heads, blocks = 0, [], []
                while at < len(content):
                    end = content.index(b"\r\n\r\n", at) + 4
                    n = int(length.search(content, at, end)[1])
                    heads.append(content[at:end])
                    blocks.append(content[end : end + n])
                    at = end + n + 4
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(blocks, pa.binary())], ["header", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return files.mapInArrow(lean(batches), "header binary, block binary")


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract query: page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from WARC files."""
    path = scratch_path(spark, "archive")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    export(spark, path, f"{path}/warc", "gzip")
    number = lambda c: F.regexp_extract(c, r"<urn:x-page:(-?\d*)>", 1).try_cast("bigint")
    h = F.col("header")
    read = load(spark, f"{path}/warc").select(
        number(header_field(h, "WARC-Record-ID")).alias("page_id"),
        header_field(h, "WARC-Type").alias("record_type"),
        number(header_field(h, "WARC-Refers-To")).alias("refers_to"),
        F.regexp_replace(header_field(h, "WARC-Payload-Digest"), "^sha1:", "").alias("named"),
        F.length("block").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("block")).alias("payload_digest"),
    )
    read = written(read, "records-read")
    # A revisit has the payload of the response that it refers to.
    told = read.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    stored = read.filter("record_type = 'response'")
    named = F.when(F.col("payload_digest") == F.col("named"), F.col("named")).otherwise(F.raise_error(F.lit("payload does not fit its digest")).cast("string"))
    own = stored.join(told.select(F.col("refers_to").alias("page_id"), "named").distinct(), ["page_id", "named"], "left_semi")
    own = written(own.select("page_id", "named", "payload_bytes", "payload_digest").distinct(), "revisited")
    few = own.count() * ROW_BYTES * 2 <= BROADCAST_BYTES
    side = own.withColumnRenamed("page_id", "refers_to")
    told = told.join(F.broadcast(side) if few else side.hint("merge"), ["refers_to", "named"])
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return stored.withColumn("payload_digest", named).select(*names).unionByName(told.select(*names))


OP4_SQL = """
with p as (
  select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages
), f as (
  select page_id, strlen(t) as n, h, min(page_id) over (partition by h) as first from p
)
select page_id, n::bigint as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31), 1)), 'string_agg', '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from f
"""
