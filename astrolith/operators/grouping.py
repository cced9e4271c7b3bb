"""Grouping tables: members are resolved against the catalog of HDUs by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows with hdu: the member that each row names, or null.

    rows has location, position, name and version; catalog has hdu, extname and extver.  A location
    is in another file and gives null.  A position in the catalog comes first, else the first HDU of
    that name (in any case) and version, which is 1 if it is not given.
    """
    by_place = catalog.select(F.col("hdu").alias("_place"))
    names = catalog.select(F.upper(F.trim("extname")).alias("_name"), F.coalesce("extver", F.lit(1)).alias("_version"), "hdu")
    by_name = names.groupBy("_name", "_version").agg(F.min("hdu").alias("_named"))
    here = F.coalesce(F.trim("location"), F.lit("")) == ""
    found = rows.join(by_place, here & (F.col("position") == F.col("_place")), "left")
    found = found.join(by_name, here & F.col("_place").isNull() & (F.upper(F.trim("name")) == F.col("_name")) & (F.coalesce("version", F.lit(1)) == F.col("_version")), "left")
    return found.withColumn("hdu", F.coalesce("_place", "_named")).drop("_place", "_name", "_version", "_named")


def members(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Only the rows whose members are there."""
    return resolve(rows, catalog).filter("hdu is not null")


def links(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows (hdu, grpid, grplc) with the extname of the group that each points at, if it is in this file."""
    groups = catalog.select(F.col("hdu").alias("_group"), "extname")
    return rows.join(groups, (F.col("grpid") > 0) & F.col("grplc").isNull() & (F.col("grpid") == F.col("_group")), "left").drop("_group")


def next_free(rows: DataFrame, hdu: str, number: str) -> DataFrame:
    """For each HDU the least group number from 1 to 999 that it does not use, and how many it uses."""
    used = rows.groupBy(hdu).agg(F.collect_set(number).alias("_used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(999)), "_used"))
    return used.select(hdu, free.alias("next_id"), F.size("_used").alias("members"))


def add_member(rows: DataFrame, member: DataFrame) -> DataFrame:
    """rows and one more, unless it is there."""
    return rows.unionByName(member.join(rows, member.columns, "left_anti"))


def remove_member(rows: DataFrame, member: DataFrame, by: list[str]) -> DataFrame:
    """rows without those that member names."""
    return rows.join(member, by, "left_anti")
