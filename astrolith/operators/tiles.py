"""Tiles of images: quantization, coding and decoding, a row or a group for each tile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import codecs
from ..sources.codecs import NULL_CODE, ZERO_CODE


def quantize_parameters(pixels: DataFrame, tile: str, value: str) -> DataFrame:
    """(tile, scale, zero, lossless) from the finite values of each tile.

    A tile of one value has scale 1; one with infinite or without finite values is kept lossless.
    """
    v = F.col(value)
    finite = ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = pixels.groupBy(tile).agg(
        F.min(F.when(finite, v)).alias("_low"), F.max(F.when(finite, v)).alias("_high"), F.bool_or(F.abs(v) == F.lit(float("inf"))).alias("_inf")
    )
    flat = F.col("_low") == F.col("_high")
    scale = F.when(flat, F.lit(1.0)).otherwise((F.col("_high") - F.col("_low")) / F.lit(100000.0))
    zero = F.when(flat, F.col("_low")).otherwise((F.col("_low") + F.col("_high")) / F.lit(2.0))
    lossless = F.coalesce(F.col("_inf"), F.lit(False)) | F.col("_low").isNull() | (scale == F.lit(float("inf")))
    return rows.select(tile, scale.alias("scale"), zero.alias("zero"), lossless.alias("lossless"))


def quantize(value: Column, scale: Column, zero: Column, draw: Column | float = 0.5, keep_zero: bool = False) -> Column:
    """The stored integer of a real value; draw is the pixel's random number, one half without dithering."""
    draw = F.lit(draw) if isinstance(draw, float) else draw
    x = F.round((value - zero) / scale + (draw - 0.5)).cast("int")
    x = F.when(value == 0, F.lit(ZERO_CODE)).otherwise(x) if keep_zero else x
    return F.when(F.isnan(value) | value.isNull(), F.lit(NULL_CODE)).otherwise(x)


def unquantize(stored: Column, scale: Column, zero: Column, draw: Column | float = 0.5, keep_zero: bool = False) -> Column:
    """The real value of a stored integer; null for the code of NaN."""
    draw = F.lit(draw) if isinstance(draw, float) else draw
    x = (stored - draw + 0.5) * scale + zero
    x = F.when(stored == ZERO_CODE, F.lit(0.0)).otherwise(x) if keep_zero else x
    return F.when(stored != NULL_CODE, x)


def _slices(lists):
    """The values of each list of an Arrow array, as views of one numpy array."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def _lists(parts: list[np.ndarray]):
    """An Arrow array of lists of 64-bit integers."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)))


def encode(tiles: DataFrame, codec: str, kind: np.dtype, block: int = 32) -> DataFrame:
    """(tile, data) from (tile, values, shape): each tile's bytes; shape may be null."""

    def batches(frames):
        import pyarrow as pa

        for batch in frames:
            shapes = batch.column("shape").to_pylist()
            out = [codecs.encode(codec, v.astype(kind), block, tuple(s) if s else None) for v, s in zip(_slices(batch.column("values")), shapes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("tile"), pa.array(out, pa.binary())], ["tile", "data"])

    return tiles.select("tile", "values", "shape").mapInArrow(batches, "tile bigint, data binary")


def decode(tiles: DataFrame, codec: str, kind: np.dtype, block: int = 32) -> DataFrame:
    """(tile, values) from (tile, data, count)."""

    def batches(frames):
        import pyarrow as pa

        for batch in frames:
            both = zip(batch.column("data").to_pylist(), batch.column("count").to_pylist(), strict=True)
            out = [codecs.decode(codec, x, n, kind, block) for x, n in both]
            yield pa.RecordBatch.from_arrays([batch.column("tile"), _lists(out)], ["tile", "values"])

    return tiles.select("tile", "data", "count").mapInArrow(batches, "tile bigint, values array<bigint>")


def roundtrip(pixels: DataFrame, order: str, tile: str, value: str, codec: str, kind: np.dtype) -> DataFrame:
    """pixels after coding and decoding: (order, value); a tile's pixels are taken in order and shuffled once."""
    rows = pixels.groupBy(F.col(tile).alias("tile")).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("p"))
    rows = rows.select(F.transform("p", lambda x: x[order].cast("bigint")).alias("keys"), F.transform("p", lambda x: x[value].cast("bigint")).alias("values"))

    def batches(frames):
        import pyarrow as pa

        for batch in frames:
            out = []
            for v in _slices(batch.column("values")):
                # Two axes for codecs that need them: rows of as many pixels as divide the tile, ten at most.
                wide = max(k for k in range(1, 11) if len(v) % k == 0)
                data = codecs.encode(codec, v.astype(kind), 32, (len(v) // wide, wide))
                out.append(codecs.decode(codec, data, len(v), kind, 32).astype(np.int64))
            flat = np.concatenate([np.zeros(0, np.int64), *out])
            yield pa.RecordBatch.from_arrays([batch.column("keys").flatten(), pa.array(flat)], [order, value])

    return rows.mapInArrow(batches, f"`{order}` bigint, `{value}` bigint")
