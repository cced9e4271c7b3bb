"""Edits of tables as transformations: rows and columns, and the layout of a heap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BadTform, RowOutOfRange
from ..functions.text import resolve

_ZEROS = {"string": "", "boolean": False, "binary": b""}


def _zero_rows(rows: DataFrame, number: str, first, count: int) -> DataFrame:
    """count rows of zeros, numbered from first on."""
    spark = rows.sparkSession
    made = spark.range(count).select((F.col("id") + first).alias(number))
    for f in rows.schema.fields:
        if f.name == number:
            continue
        kind = f.dataType.simpleString()
        zero = F.array().cast(kind) if kind.startswith("array") else F.lit(_ZEROS.get(kind, 0)).cast(kind)
        made = made.withColumn(f.name, zero)
    return made.select(*[F.col(number).cast(rows.schema[number].dataType) if c == number else F.col(f"`{c}`") for c in rows.columns])


def append_rows(rows: DataFrame, number: str, count: int) -> DataFrame:
    """count rows of zeros at the end."""
    size = rows.count()
    return rows.unionByName(_zero_rows(rows, number, size, count))


def insert_rows(rows: DataFrame, number: str, before: int, count: int) -> DataFrame:
    """count rows of zeros before a row, numbered from 0."""
    if before < 0 or count < 0:
        raise RowOutOfRange(str(before))
    moved = rows.withColumn(number, F.when(F.col(number) >= before, F.col(number) + count).otherwise(F.col(number)))
    return moved.unionByName(_zero_rows(rows, number, before, count))


def delete_rows(rows: DataFrame, number: str, first: int, count: int) -> DataFrame:
    """All but count rows from first on."""
    if first < 0 or count < 0:
        raise RowOutOfRange(str(first))
    kept = rows.filter(~F.col(number).between(first, first + count - 1))
    return kept.withColumn(number, F.when(F.col(number) >= first + count, F.col(number) - count).otherwise(F.col(number)))


def copy_rows(rows: DataFrame, number: str, source: int, count: int, target: int) -> DataFrame:
    """Rows target ... take the values that rows source ... had; ranges may overlap.

    Only the copied range is joined, and it is filtered before the join.
    """
    names = [c for c in rows.columns if c != number]
    taken = rows.filter(F.col(number).between(source, source + count - 1)).select(
        (F.col(number) - source + target).alias(number), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_new")
    )
    joined = rows.join(taken, number, "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(f"`{c}`")).alias(c) if c != number else F.col(number) for c in rows.columns])


def insert_column(df: DataFrame, name: str, value: Column, at: int) -> DataFrame:
    """df with one more column at a place."""
    names = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*names[:at], value.alias(name), *names[at:])


def delete_column(df: DataFrame, pattern: str) -> DataFrame:
    """df without the one column that fits a pattern."""
    return df.drop(resolve(df.columns, pattern))


def copy_column(df: DataFrame, source: str, target: str) -> DataFrame:
    """The values of one column in another's place; both must have the same type."""
    source, target = resolve(df.columns, source), resolve(df.columns, target)
    if df.schema[source].dataType != df.schema[target].dataType:
        raise BadTform(f"{source} and {target} differ")
    return df.withColumn(target, F.col(f"`{source}`"))


def compact(cells: DataFrame, size: str, order: str, by: list[str]) -> DataFrame:
    """cells with new_offset: live cells laid out one after the other, in order, for each group.

    by names what has a heap of its own, such as a file's HDU; it bounds each window.
    """
    w = Window.partitionBy(*by).orderBy(order)
    return cells.withColumn("new_offset", F.sum(size).over(w) - F.col(size))
