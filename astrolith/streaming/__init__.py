"""FITS files as they arrive in a folder, as a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources import content


def arriving(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.fits", per_trigger: int = 16, **options) -> DataFrame:
    """A streaming DataFrame of the rows of each new file; at most ``per_trigger`` files in a micro-batch.

    schema is that of one file (``content.schema_of``).  Every column expression of this library
    works on the stream as it does on a table.
    """
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)
    )
    return content.decode(files, schema, **options)
