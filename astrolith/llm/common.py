"""What the operators share: shared scratch tables, size-checked joins and connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its rows times this many bytes fit the bound below.
ROW_BYTES = 64
#: The most bytes that are ever broadcast.
BROADCAST_BYTES = 64 << 20

#: A run of these is a word: everything but the six ASCII blanks.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only on one machine, as in tests, a folder of that
    machine takes its place; on a cluster it is an error if no shared folder is named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return os.path.dirname(kept.get().rstrip("/"))
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "astrolith-shared")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/astrolith-{uuid.uuid4().hex}-{name}"
    there, system = _at(spark, path)
    system.deleteOnExit(there)
    return path


def _at(spark: SparkSession, path: str):
    """A path's Hadoop path and file system."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: its lineage is cut there and it is computed once."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        there, system = _at(df.sparkSession, df._scratch)
        system.delete(there, True)


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows whose key is not in ids (a written table of one column with distinct values).

    ids is broadcast only if its counted size is below BROADCAST_BYTES, so that the wide rows need
    not be shuffled; beyond that it is an ordinary shuffled anti join.
    """
    few = ids.count() * ROW_BYTES <= BROADCAST_BYTES
    side = F.broadcast(ids) if few else ids.hint("merge")
    return rows.join(side, key, "left_anti")


def task_count(spark: SparkSession, amount: int = 0, each: int = 1) -> int:
    """The session's number of shuffle partitions, or more if each is to hold so much of the amount at most."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def size_of(df: DataFrame) -> int:
    """Catalyst's estimate of df's bytes, which for tables in files is their size; 0 where it has none."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else 0


def words_of(text: Column) -> Column:
    """The array of a text's words; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lean(batches):
    """A function for mapInArrow that leaves little behind in the worker, which Spark uses again.

    Caches that another stage left are dropped before it, and freed memory goes back after it.
    """

    def run(frames):
        import gc
        import sys

        from pyspark import TaskContext

        kept, stage = sys.modules.get("_astrolith_kept"), TaskContext.get().stageId()
        if kept is not None and kept.stage != stage:
            del sys.modules["_astrolith_kept"], kept
            gc.collect()
        try:
            yield from batches(frames)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Give memory that is free in this process back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def kept(name: str, make):
    """What make() gives, kept in the worker from task to task of a stage."""
    import sys
    import types

    from pyspark import TaskContext

    own = sys.modules.setdefault("_astrolith_kept", types.ModuleType("_astrolith_kept"))
    context = TaskContext.get()
    own.stage = context.stageId() if context else None
    if name not in own.__dict__:
        own.__dict__[name] = make()
    return own.__dict__[name]


def slices(column, rows: int = 512):
    """The values of an Arrow column as lists, so many at a time."""
    for a in range(0, len(column), rows):
        yield column[a : a + rows].to_pylist()


def connected(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node that an edge (a, b) touches; root is its component's least node.

    Alternating large-star and small-star steps until nothing changes: the number of rounds grows
    with the logarithm of the longest chain.  No step gathers a component: the minima are partial
    aggregates, and both sides of the joins are plain exchanges, which AQE may split when skewed.
    Every round is written to the shared folder.
    """
    edges = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    seen = _state(edges)
    while True:
        for step in (_large_star, _small_star):
            before = edges
            edges, least = step(before, name)
            edges = written(edges, name)
            forget(before, least)
        now = _state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges: the same before and after a round only if nothing changed."""
    mixed = F.xxhash64("u", "v")
    row = edges.agg(
        F.count("*"), F.sum(mixed.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(mixed, 32))
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Each node gives its larger neighbours to the least of its neighbourhood; and a table to forget."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    given = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return given.distinct(), least


def _small_star(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Each node gives its smaller neighbours, and itself, to the least of them; and a table to forget."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    given = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return given.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), least
