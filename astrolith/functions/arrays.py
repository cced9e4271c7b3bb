"""Arrays whose first axis varies fastest: linear indexes, coordinates and strided sections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_index(coords: list[Column], shape: list[int]) -> Column:
    """The place of coordinates (from 0) in storage order; an error outside of the array."""
    at, step, good = F.lit(0).cast("bigint"), 1, F.lit(True)
    for c, n in zip(coords, shape, strict=True):
        at, step, good = at + c * F.lit(step), step * n, good & (c >= 0) & (c < n)
    return F.when(good, at).otherwise(F.raise_error(F.lit("BadDimensions")).cast("bigint"))


def unravel(index: Column, shape: list[int]) -> list[Column]:
    """The coordinates, from 0, of a place in storage order."""
    out, step = [], 1
    for n in shape:
        out.append(F.pmod(F.floor(index / F.lit(step)), F.lit(n)).cast("bigint"))
        step *= n
    return out


def section_counts(lower: list[int], upper: list[int], stride: list[int]) -> list[int]:
    """How many places of each axis a section has; bounds are inclusive and count from 0."""
    from ..errors import BadDimensions

    if any(low > high or s < 1 or low < 0 for low, high, s in zip(lower, upper, stride, strict=True)):
        raise BadDimensions(f"section {lower} {upper} {stride}")
    return [(high - low) // s + 1 for low, high, s in zip(lower, upper, stride, strict=True)]


def in_section(coords: list[Column], lower: list[int], upper: list[int], stride: list[int]) -> Column:
    """Whether coordinates are in a section."""
    good = F.lit(True)
    for c, low, high, s in zip(coords, lower, upper, stride, strict=True):
        good = good & c.between(low, high) & ((c - low) % s == 0)
    return good


def section_index(coords: list[Column], lower: list[int], upper: list[int], stride: list[int]) -> Column:
    """The place of coordinates in the section, in storage order."""
    at, step = F.lit(0).cast("bigint"), 1
    for c, low, s, n in zip(coords, lower, stride, section_counts(lower, upper, stride), strict=True):
        at, step = at + F.floor((c - low) / s).cast("bigint") * F.lit(step), step * n
    return at


def section(pixels: DataFrame, index: str, shape: list[int], lower: list[int], upper: list[int], stride: list[int]) -> DataFrame:
    """The pixels of a section, their index counted inside it; the filter is on plain columns and is pushed."""
    from ..errors import BadDimensions

    if any(high >= n for high, n in zip(upper, shape, strict=True)):
        raise BadDimensions(f"section beyond {shape}")
    coords = unravel(F.col(index), shape)
    return pixels.filter(in_section(coords, lower, upper, stride)).withColumn(index, section_index(coords, lower, upper, stride))


def overlay(base: DataFrame, new: DataFrame, index: str, value: str) -> DataFrame:
    """base with the values of new where it has them; index is a key of both."""
    over = new.select(F.col(index), F.col(value).alias("_new"))
    return base.join(over, index, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def reshape(pixels: DataFrame, index: str, value: str, count: int, zero) -> DataFrame:
    """The first count values in storage order; what is missing is zero."""
    every = pixels.sparkSession.range(count).select(F.col("id").alias(index))
    return every.join(pixels.select(index, value), index, "left").withColumn(value, F.coalesce(value, F.lit(zero)))


def tiles(shape: list[int], tile: list[int]) -> list[int]:
    """How many tiles each axis has."""
    return [math.ceil(n / t) for n, t in zip(shape, tile, strict=True)]


def tile_of(coords: list[Column], shape: list[int], tile: list[int]) -> Column:
    """The number, from 0, of the tile that coordinates are in."""
    at, step = F.lit(0).cast("bigint"), 1
    for c, t, n in zip(coords, tile, tiles(shape, tile), strict=True):
        at, step = at + F.floor(c / t).cast("bigint") * F.lit(step), step * n
    return at
