"""FITS files as bytes that Spark itself reads: from any store it knows, or from a column.

The ``fits`` source opens files by path, which only reaches what is mounted on every machine.  Here
Spark's binaryFile source fetches each file as a whole and a task decodes it, so a file is limited
to what fits a task's memory.
"""

from __future__ import annotations

import gzip
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import filespec
from .fits import READERS, size_of


def plan_of(mode: str = "table", hdu: int | None = None, extname: str | None = None, extver: int | None = None, columns: list[str] | None = None, section: str | None = None, raw: bool = False) -> dict:
    """The options of the fits source as a reader takes them."""
    cut = filespec.parse(f"x[{section}]").section if section else None
    return {"paths": [], "mode": mode, "hdu": hdu, "extname": extname, "extver": extver, "columns": columns, "section": cut, "rows": None, "raw": raw, "size": 1 << 20}


def schema_of(content: bytes, **options) -> T.StructType:
    """The schema that a file reads as."""
    plan = plan_of(**options)
    reader = READERS[plan["mode"]]
    if hasattr(reader, "table"):
        return reader.table
    f = io.BytesIO(content)
    return reader.columns(reader.find(f, plan), plan)


def decode(files: DataFrame, schema: T.StructType, content: str = "content", path: str = "path", **options) -> DataFrame:
    """The rows of all files in a column of bytes."""
    plan = plan_of(**options)

    def batches(frames):
        reader = READERS[plan["mode"]](plan, schema)
        for batch in frames:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_py()
                if raw is not None:
                    yield from reader.whole(io.BytesIO(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw), name)

    return files.select(path, content).mapInArrow(batches, schema)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of all FITS files under a path; they must have the same schema as the first."""
    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").first()
    return decode(files, schema_of(bytes(first["content"]), **options), **options)


__all__ = ["decode", "plan_of", "read", "schema_of", "size_of"]
