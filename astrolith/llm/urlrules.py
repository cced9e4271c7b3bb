"""URL rules by a sort-merge range join.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's.
Host labels are reversed, so that a canonical key is ``com.example`` + path; under one host, the keys
that a rule fits are an interval: all from the rule's own key to the last that starts with it.  A
url has a key for its host and one for each parent domain that has rules.  Keys and the intervals'
beginnings are sorted together, and a sweep keeps the stack of rules whose intervals are open: they
are nested, and the innermost one is the longest that fits.  The longest over a url's keys wins.

Keys of one host are dealt over as many groups as the host's share of all keys asks for; the host's
rules go to each group.  The sweep holds nothing but its stack.

Defined cases: a null url, or one without ``://``, has an empty host and path, which rules with an
empty host would fit; of rules as long as each other that fit, which are of different hosts and paths
only if one has more host and the other more path, the greater as text wins; equal rules count once (the smaller verdict, ``allow``, stays); null parts of
a rule are empty; rows that repeat are judged each if their key differs, and share a row if equal in
all respects they are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import task_count, written

DEFAULT = "allow"
#: Rows that a task of the sweep has at most.
PART_ROWS = 1 << 21


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end; A-Z are lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def parents(host: Column, depth: int) -> Column:
    """The host and its parent domains of at most depth labels, reversed: com, com.example, ..."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda n: F.array_join(F.slice(labels, 1, n), "."))


def judge(urls: DataFrame, rules: DataFrame, key: str, url: str, default: str = DEFAULT) -> DataFrame:
    """(key, host, path, rule, verdict) for each row of urls.

    rules has host, path and verdict (allow or block).
    """
    spark = urls.sparkSession
    kind = urls.schema[key].dataType.simpleString()
    rules = rules.select(
        F.array_join(F.reverse(F.split(F.translate(F.coalesce("host", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"\.")), ".").alias("domain"),
        F.coalesce("path", F.lit("")).alias("path"), "verdict",
    ).groupBy("domain", "path").agg(F.min("verdict").alias("verdict"))
    rules = written(rules, "rules")
    depth = rules.agg(F.max(F.size(F.split("domain", r"\.")))).first()[0] or 1
    rows = urls.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # Rows that repeat a url under one key are judged once and counted.
    rows = written(rows.groupBy("key", "host", "path").agg(F.count("*").alias("times")), "urls")
    keys = rows.select("key", "host", "path", F.explode(parents(F.col("host"), depth)).alias("domain"))
    keys = keys.join(rules.select("domain").distinct(), "domain", "left_semi")
    # How many groups each host's keys are dealt over, by its share of all keys.
    counts = written(keys.groupBy("domain").agg(F.count("*").alias("n")), "domains")
    total = counts.agg(F.sum("n")).first()[0] or 1
    parts = task_count(spark, total, PART_ROWS)
    counts = counts.select("domain", F.ceil(F.col("n") * (4 * parts) / total).cast("int").alias("groups"))
    keys = keys.join(counts, "domain").select("domain", F.pmod(F.xxhash64("key", "path"), F.col("groups")).cast("int").alias("g"), "path", F.lit(1).alias("kind"), "key", "host", F.lit(None).cast("string").alias("verdict"))
    opened = rules.join(counts, "domain").select("domain", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "path", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("key"), F.lit(None).cast("string").alias("host"), "verdict")
    events = keys.unionByName(opened).repartition(parts, "domain", "g").sortWithinPartitions("domain", "g", "path", "kind")

    def sweep(frames):
        import pyarrow as pa

        at, stack = None, []
        for batch in frames:
            names = ["domain", "g", "path", "kind", "key", "host", "verdict"]
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(names)}
            out = {"at": [], "path": [], "rule": [], "verdict": []}
            for i, group in enumerate(zip(cols["domain"], cols["g"], strict=True)):
                if group != at:
                    at, stack = group, []
                path = cols["path"][i]
                while stack and not path.startswith(stack[-1][0]):
                    stack.pop()  # its interval ended before this key
                if cols["kind"][i] == 0:
                    stack.append((path, cols["verdict"][i]))
                elif stack:
                    rule = ".".join(reversed(group[0].split("."))) + stack[-1][0]
                    for n, v in zip(out, (i, path, rule, stack[-1][1]), strict=True):
                        out[n].append(v)
            taken = pa.array(out["at"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(4).take(taken), batch.column(5).take(taken), pa.array(out["path"], pa.string()), pa.array(out["rule"], pa.string()), pa.array(out["verdict"], pa.string())],
                ["key", "host", "path", "rule", "verdict"],
            )

    hits = events.mapInArrow(sweep, f"key {kind}, host string, path string, rule string, verdict string")
    longest = F.max(F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("verdict"))).alias("hit")
    hits = hits.groupBy("key", "host", "path").agg(longest)
    same = [rows[c].eqNullSafe(hits[c]) for c in ("key", "host", "path")]
    found = rows.join(hits, same[0] & same[1] & same[2], "left").select(
        rows["key"].alias(key), rows["host"], rows["path"], F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.lit(default)).alias("verdict"), "times",
    )
    again = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("n")
    return found.select(key, "host", "path", "rule", "verdict", again).drop("n")


#: The contract's rules.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op6(spark, sf_dir: str) -> DataFrame:
    """Contract query: page_id, host, path, rule, verdict of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules, "page_id", "url")


OP6_SQL = """
with p as (
  select page_id, coalesce(url, '') as u from pages
), q as (
  select page_id,
    translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from p
), r(rh, rp, rv) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
)
select page_id, host, path,
  (select max_by(rh || rp, length(rh || rp)) from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) as rule,
  coalesce((select max_by(rv, length(rh || rp)) from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)), 'allow') as verdict
from q
"""
