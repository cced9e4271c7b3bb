"""Sessions for this library."""

from __future__ import annotations

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """A session's settings that the library relies on: UTC, and the fits source."""
    from .sources.fits import register

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return register(spark)
