"""Line dedup by overlapping three-line windows.

The lines of a text that are not blank, trimmed, form windows of three consecutive lines.  A window
that occurs more than once anywhere is kept at its first occurrence, by document id and place, and
every later one covers its lines.  Covered places of a document are merged, and their lines, with
the blank lines between them, are left out.

Windows are 128 bits of hash each.  They are counted by partial aggregates, and only those that
repeat are joined back; both sides of that join are plain exchanges, which AQE splits if a window is
in a third of all documents.

Defined cases: a null text stays null; texts with fewer than three such lines stay as they are; rows
that repeat an id count as one document, so none of them is a later occurrence of the other; rows
with a null id come last, in their texts' order; line ends other than a line feed are part of lines.
Only blanks (U+0020) are trimmed: a line of tabs is a full line.  A column ``lines_removed`` of docs is
replaced by the one that is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ROW_BYTES, written

WINDOW = 3
#: Bytes of a span in a broadcast row: two numbers, their row and its place.
SPAN_BYTES = 40


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _kept_places(lines: Column) -> Column:
    """The indexes, from 0, of the lines that are not blank."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.trim(lines[i]) != "")


def windows(docs: DataFrame, key: str, text: str, width: int = WINDOW) -> DataFrame:
    """(id, tie, at, until, a, b): a row per window; from line at to line until, hashed to (a, b)."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.when(F.col(key).isNull(), F.md5(F.col(text).cast("binary"))).otherwise("").alias("tie"), _lines(F.col(text)).alias("lines"))
    rows = rows.withColumn("places", _kept_places(F.col("lines"))).filter(F.size("places") >= width)
    hashes = F.transform("places", lambda i: F.struct(i.alias("i"), F.xxhash64(F.trim(F.col("lines")[i])).alias("a"), F.xxhash64(F.lit("2"), F.trim(F.col("lines")[i])).alias("b")))
    rows = rows.select("id", "tie", hashes.alias("h"))

    def window(k):
        part = [F.get(F.col("h"), k + n) for n in range(width)]
        return F.struct(
            part[0]["i"].alias("at"), part[-1]["i"].alias("until"),
            F.xxhash64(*[p["a"] for p in part], *[p["b"] for p in part]).alias("a"), F.xxhash64(*[p["b"] for p in part], *[p["a"] for p in part]).alias("b"),
        )

    spread = F.transform(F.sequence(F.lit(0), F.size("h") - width), window)
    return rows.select("id", "tie", F.inline(spread))


def _order() -> Column:
    """Where a window stands: known ids first, then by id, text and line."""
    return F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("tie"), F.col("at"))


def covered(docs: DataFrame, key: str, text: str, width: int = WINDOW) -> DataFrame:
    """(id, tie, spans) for each document that has later occurrences: merged (at, until) of lines."""
    # 32 bytes for each window, written so that the texts are split and hashed once.
    rows = written(windows(docs, key, text, width), "windows")
    repeated = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(_order()).alias("first")).filter("n > 1").drop("n")
    repeated = written(repeated, "repeated-windows")
    later = rows.join(repeated.hint("merge"), ["a", "b"]).filter(_order() > F.col("first"))
    return written(later.groupBy("id", "tie").agg(F.collect_set(F.struct("at", "until")).alias("spans")), "covered")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """docs with the lines of later occurrences left out of text, and lines_removed: how many."""
    spans = covered(docs, key, text, width)
    tie = F.when(F.col(key).isNull(), F.md5(F.col(text).cast("binary"))).otherwise("")
    names = [c for c in docs.columns if c != "lines_removed"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(key).alias("id"), F.coalesce(tie, F.lit("")).alias("tie"), F.col(text).alias("text"))
    found = spans.select(F.col("id").alias("of"), F.col("tie").alias("of_tie"), "spans")
    # Spans are sent to the texts, not texts to the spans, as long as all of them are counted to be small.
    size = spans.agg(F.sum(F.size("spans") * SPAN_BYTES + ROW_BYTES)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_BYTES else found.hint("merge")
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("of_tie")), "left")
    # Covered lines merged: a line is out if it lies in one of the spans.
    marks = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["until"]))))
    every = F.sequence(F.lit(0), F.size(_lines(F.col("text"))) - 1)
    # The lines are bound to a variable: the text is split once and not again for each line.
    left = F.transform(F.array(_lines(F.col("text"))), lambda own: F.array_join(F.transform(F.array_except(every, marks), lambda i: F.get(own, i)), "\n"))[0]
    rows = rows.withColumn("left", F.when(F.col("spans").isNull(), F.col("text")).otherwise(left))
    full = lambda t: F.size(F.filter(_lines(F.col(t)), lambda line: F.trim(line) != ""))
    gone = F.when(F.col("spans").isNull(), 0).otherwise(full("text") - full("left"))
    return rows.select(*[F.col("left").alias(c) if c == text else F.col("row")[c].alias(c) for c in names], gone.alias("lines_removed"))


def op7(spark, sf_dir: str) -> DataFrame:
    """doc_id, text without later occurrences of three-line windows, lines_removed, of every document."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP7_SQL = r"""
with l as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i, unnest(string_split(text, chr(10))) as line from documents
), k as (
  select doc_id, i, trim(line, ' ') as t, row_number() over w as r, lead(trim(line, ' '), 1) over w as t2, lead(trim(line, ' '), 2) over w as t3, lead(i, 2) over w as until
  from l where trim(line, ' ') <> '' window w as (partition by doc_id order by i)
), f as (
  select *, row_number() over (partition by t, t2, t3 order by doc_id, i) as nth from k where t3 is not null
), c as (
  select distinct doc_id, unnest(range(i, until + 1)) as i from f where nth > 1
), m as (
  select l.doc_id, string_agg(l.line, chr(10) order by l.i) filter (where c.i is null) as text,
    (count(*) filter (where c.i is not null and trim(l.line, ' ') <> ''))::int as lines_removed
  from l left join c on c.doc_id = l.doc_id and c.i = l.i group by l.doc_id
)
select d.doc_id, case when m.doc_id is null or d.text is null then d.text else coalesce(m.text, '') end as text, coalesce(m.lines_removed, 0)::int as lines_removed
from documents d left join m on m.doc_id = d.doc_id
"""
