"""The Spark data source ``fits``: a file's HDUs, cards, tables, images, groups and tiles as DataFrames.

The driver walks headers only as far as it needs to and plans partitions by ranges of rows, pixels,
groups or tiles; each task seeks its own range and decodes it with numpy into Arrow batches.

Options: ``path`` (an extended file name, or several paths, folders or patterns between commas), ``mode`` (hdus, cards,
table, image, groups, tiles; table by default), ``hdu`` (from 1), ``extname``, ``extver``, ``columns``
(names or wildcards between commas), ``rows`` (first:last, from 0, inclusive: of rows, pixels, groups
or tiles), ``section`` (from 1, as in extended names; not together with rows), ``raw`` (true: stored
values, no scaling and no nulls), ``withPath`` (true: a column path first), ``partitionRows``.

``rows`` and ``section`` narrow what is read; other filters are Spark's own, above the scan: a source's
state outlives a query, so a pushed filter would narrow later queries of the same DataFrame too.
Of many files only the first and large ones are opened on the driver; others are a task each.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pyspark.sql.pandas.types import to_arrow_schema

from .. import errors
from ..functions.text import resolve, wildcard
from . import codecs, filespec, integrity, remote
from .fits_sink import FitsWriter
from .header import LIMITS, Hdu, scan
from .schema import NUMPY, WHOLE_DIGITS, Field, fields_of, parse_binary, whole_or_real, width_of

def struct(text: str) -> T.StructType:
    """A schema of simple names and types; unlike fromDDL it needs no session."""
    own = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    own |= {f"array<{k}>": T.ArrayType(v) for k, v in own.items()}
    return T.StructType([T.StructField(n, own[k]) for n, k in (x.split() for x in text.split(", "))])


HDUS = struct(
    "path string, hdu int, kind string, extname string, extver int, bitpix int, naxis int, axes array<bigint>, pcount bigint, gcount bigint, "
    "header_off bigint, data_off bigint, data_bytes bigint, truncated boolean, tfields int, datasum_status string, checksum_status string"
)
CARDS = struct(
    "path string, hdu int, idx int, name string, kind string, raw string, value_type string, v_int bigint, v_float double, v_bool boolean, v_str string, v_re double, v_im double, comment string, unit string"
)


def open_file(path: str):
    """A readable, seekable file or URL; one that ends in .gz is inflated as a whole."""
    if remote.scheme_of(path):
        f = remote.open_url(path)
        return io.BytesIO(inflated(f, path)) if path.lower().endswith(".gz") else f
    path = path.removeprefix("file://").removeprefix("file:")
    try:
        if path.lower().endswith(".gz"):
            with open(path, "rb") as f:
                return io.BytesIO(inflated(f, path))
        return open(path, "rb")  # noqa: SIM115
    except FileNotFoundError:
        raise errors.NotFound(path) from None


def inflated(f, path: str) -> bytes:
    """The whole of a gzip file, up to the allocation limit."""
    data = gzip.GzipFile(fileobj=f).read(LIMITS["allocation"] + 1)
    if len(data) > LIMITS["allocation"]:
        raise errors.LimitExceeded(path)
    return data


def size_of(f) -> int:
    return f.seek(0, 2)


def select(f, hdu: int | None = None, extname: str | None = None, extver: int | None = None, wanted=None) -> Hdu:
    """An HDU by number, by name and version, or the first that ``wanted`` likes."""
    first = None
    for h in scan(f, size_of(f), hdu):
        first = first or h
        if hdu is not None:
            if h.number == hdu:
                return h
        elif extname is not None:
            if (h.extname or "").strip().upper() == extname.strip().upper() and h.extver == (extver or 1):
                return h
        elif wanted is None or wanted(h):
            return h
    raise errors.WrongHduType(f"no HDU {hdu or extname or ''}")


#: Of more files than this only those of at least SPLIT_BYTES are opened on the driver to be split.
SPLIT_FILES, SPLIT_BYTES = 64, 1 << 26
#: The longest piece of a section's line that is read at a time, in pixels of the section.
LINE_PIXELS = 1 << 20
#: Bytes between two pieces of a file that are read rather than skipped.
GAP = 1 << 16


def expand(path: str) -> list[str]:
    """The files that a path stands for: itself, a folder's, or those that fit a pattern."""
    if remote.scheme_of(path):
        return [path]
    plain = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(plain):
        return sorted(x for x in glob.glob(os.path.join(glob.escape(plain), "*")) if re.search(r"(?i)\.(fits?|fts)(\.gz)?$", x))
    return sorted(glob.glob(plain)) if set(plain) & set("*?") else [plain]


class Ranges(InputPartition):
    """A range of one file's units; without an end it is the whole file."""

    def __init__(self, path: str, first: int, last: int | None):
        self.path, self.first, self.last = path, first, last


class FitsSource(DataSource):
    """Registered as ``fits``; see the module."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def _plan(self) -> dict:
        o = self.options
        specs = [filespec.parse(p.strip()) for p in o["path"].split(",")] if "[" not in o["path"] else [filespec.parse(o["path"])]
        s = specs[0]
        number = int(o["hdu"]) if "hdu" in o else s.hdu
        section = filespec.parse(f"x[{o['section']}]").section if "section" in o else s.section
        paths = [x for y in specs for x in expand(y.path)]
        if not paths:
            raise errors.NotFound(o["path"])
        mode = o.get("mode", "image" if section else "table")
        if mode not in READERS:
            raise errors.WrongHduType(f"mode {mode}")
        return {
            "paths": paths, "with_path": o.get("withPath", "false").lower() == "true", "mode": mode, "hdu": number, "extname": o.get("extname", s.extname), "extver": int(o["extver"]) if "extver" in o else s.extver,
            "section": section, "columns": [c.strip() for c in o["columns"].split(",")] if "columns" in o else None, "rows": o.get("rows"),
            "raw": o.get("raw", "false").lower() == "true", "size": int(o.get("partitionRows", 1 << 20)),
        }

    def schema(self) -> T.StructType:
        plan = self._plan()
        found = READERS[plan["mode"]].infer(plan)
        named = plan["with_path"] and "path" not in found.names
        return T.StructType([T.StructField("path", T.StringType()), *found.fields]) if named else found

    def reader(self, schema: T.StructType) -> DataSourceReader:
        plan = self._plan()
        return READERS[plan["mode"]](plan, schema)

    def writer(self, schema: T.StructType, overwrite: bool):
        return FitsWriter(self.options, schema, overwrite)


class _Reader(DataSourceReader):
    """What all modes share: an HDU of each path and ranges of ``unit`` numbers."""

    def __init__(self, plan: dict, schema: T.StructType):
        self.plan, self.out = plan, schema

    @classmethod
    def wanted(cls, h: Hdu) -> bool:
        return True

    @classmethod
    def find(cls, f, plan: dict) -> Hdu:
        return select(f, plan["hdu"], plan["extname"], plan["extver"], cls.wanted)

    @classmethod
    def infer(cls, plan: dict) -> T.StructType:
        with open_file(plan["paths"][0]) as f:
            return cls.columns(cls.find(f, plan), plan)

    def partitions(self):
        out, many = [], len(self.plan["paths"]) > SPLIT_FILES
        for path in self.plan["paths"]:
            # A file of its own task: one that must be inflated as a whole, or one of many that is small.
            if path.lower().endswith(".gz") or (many and not remote.scheme_of(path) and os.path.getsize(path) < SPLIT_BYTES):
                out.append(Ranges(path, 0, None))
                continue
            with open_file(path) as f:
                h = self.find(f, self.plan)
                (low, high), step = self.units(h), self.step(h)
            out += [Ranges(path, a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        return out or [Ranges(self.plan["paths"][0], 0, -1)]

    def step(self, h: Hdu) -> int:
        """Units in a partition."""
        return max(1, self.plan["size"])

    def units(self, h: Hdu) -> tuple[int, int]:
        """The first and the last unit to read of an HDU."""
        return self.bounds(self.count(h))

    def bounds(self, count: int) -> tuple[int, int]:
        """The first and the last number to read, of so many."""
        if not self.plan["rows"]:
            return 0, count - 1
        a, _, b = self.plan["rows"].partition(":")
        if int(b or a) >= count:
            raise errors.RowOutOfRange(self.plan["rows"])
        return int(a), int(b or a)

    def read(self, partition: Ranges):
        with open_file(partition.path) as f:
            h = self.find(f, self.plan)
            if partition.last is None:
                partition = Ranges(partition.path, *self.units(h))
            if partition.first <= partition.last:
                self.here = partition.path
                yield from self.batches(f, h, partition)

    def whole(self, f, path: str):
        """All batches of an open file."""
        h, self.here = self.find(f, self.plan), path
        first, last = self.units(h)
        if first <= last:
            yield from self.batches(f, h, Ranges(path, first, last))

    def arrays(self, made: dict[str, pa.Array]) -> pa.RecordBatch:
        want = to_arrow_schema(self.out)
        if "path" in self.out.names and "path" not in made:
            made["path"] = pa.array([self.here] * len(next(iter(made.values()))), pa.string())
        return pa.RecordBatch.from_arrays([made[n].cast(want.field(n).type) if made[n].type != want.field(n).type else made[n] for n in self.out.names], schema=want)


class _Whole(_Reader):
    """Modes with a row for each HDU or card: one task for each file, as headers are a chain."""

    def partitions(self):
        return [Ranges(p, 0, 0) for p in self.plan["paths"]]

    @classmethod
    def infer(cls, plan: dict) -> T.StructType:
        return cls.table

    def read(self, partition: Ranges):
        with open_file(partition.path) as f:
            yield from self.whole(f, partition.path)

    def rows(self, rows: list[dict]):
        want = to_arrow_schema(self.out)
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], want.field(n).type) for n in self.out.names], schema=want)


class HdusReader(_Whole):
    table = HDUS

    def whole(self, f, path: str):
        size, out = size_of(f), []
        check = {"datasum_status", "checksum_status"} & set(self.out.names)
        for h in scan(f, size):
            own = {
                "path": path, "hdu": h.number, "kind": h.kind, "extname": h.extname, "extver": h.extver, "bitpix": h.bitpix, "naxis": len(h.axes), "axes": h.axes, "pcount": h.pcount,
                "gcount": h.gcount, "header_off": h.at, "data_off": h.data_at, "data_bytes": h.data_bytes, "truncated": h.end > size, "tfields": h.header.value("TFIELDS"),
            }
            states = integrity.verify(f, h) if check and h.end <= size else (None, None)
            out.append(own | {"datasum_status": states[0], "checksum_status": states[1]})
        yield from self.rows(out)


class CardsReader(_Whole):
    table = CARDS

    def whole(self, f, path: str):
        out = []
        for h in scan(f, size_of(f)):
            for i, c in enumerate(h.header.cards):
                v = c.value if c.kind in ("value", "hierarch") else None
                kind = {bool: "logical", int: "int", float: "float", complex: "complex", str: "string"}.get(type(v), "undefined") if c.kind in ("value", "hierarch") else None
                unit = c.comment[1 : c.comment.index("]")] if c.comment and c.kind != "commentary" and c.comment.startswith("[") and "]" in c.comment else None
                out.append({
                    "path": path, "hdu": h.number, "idx": i, "name": c.name, "kind": c.kind, "raw": c.raw, "value_type": kind, "v_int": v if kind == "int" else None,
                    "v_float": float(v) if kind in ("int", "float") else None, "v_bool": v if kind == "logical" else None, "v_str": v if kind == "string" else c.value if c.kind == "commentary" else None,
                    "v_re": v.real if kind == "complex" else None, "v_im": v.imag if kind == "complex" else None, "comment": c.comment, "unit": unit,
                })
        yield from self.rows(out)


def decode_values(raw: np.ndarray, field: Field, plain: bool) -> pa.Array:
    """A flat array of a field's elements, as they read: scaled, with nulls for what stands for null."""
    code = field.element or field.code
    if code == "L":
        mask = raw == 0
        return pa.array(np.isin(raw, (84, 116)), mask=None if plain else mask)
    if code in "CM":
        v = raw.astype("f4" if code == "C" else "f8").reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v[:, 0])), pa.array(np.ascontiguousarray(v[:, 1]))], ["re", "im"])
    native = raw.astype(raw.dtype.newbyteorder("="))
    if plain:
        return pa.array(native.astype("i2") if code == "B" else native)
    mask = native == field.null if isinstance(field.null, int) and code in "BIJK" else None
    if field.unsigned:
        if field.unsigned == "u64":
            return added(native, 1 << 63, mask)
        kind = {"u16": "i4", "u32": "i8", "i8": "i1"}[field.unsigned]
        return pa.array((native.astype("i8") + int(field.zero)).astype(kind), mask=mask)
    if field.whole_zero is not None:
        return added(native, field.whole_zero, mask)
    if field.scaled and code in "BIJKED":
        return pa.array(field.zero + field.scale * native.astype("f8"), mask=mask)
    return pa.array(native.astype("i2") if code == "B" else native, mask=mask)


def added(native: np.ndarray, zero: int, mask) -> pa.Array:
    """Whole numbers plus a whole zero point, exactly, as decimals of 128 bits."""
    low, negative = native.astype(np.int64).view(np.uint64), native < 0
    z = zero % (1 << 128)
    both = np.empty((len(native), 2), np.uint64)
    both[:, 0] = low + np.uint64(z & (1 << 64) - 1)
    carry = (both[:, 0] < low).astype(np.uint64)
    both[:, 1] = np.where(negative, np.uint64((1 << 64) - 1), np.uint64(0)) + np.uint64(z >> 64) + carry
    made = pa.Array.from_buffers(pa.decimal128(WHOLE_DIGITS if zero != 1 << 63 else 20, 0), len(native), [None, pa.py_buffer(both)])
    return made if mask is None else pc.if_else(pa.array(mask), pa.scalar(None, made.type), made)


def text_array(raw: np.ndarray, width: int, plain: bool = False) -> pa.Array:
    """Texts of width bytes each: up to the first NUL, without trailing blanks; null if they begin with NUL."""
    if width == 0:
        return pa.array([""] * len(raw), pa.string())
    cells = raw.reshape(-1, width)
    inside = np.logical_and.accumulate(cells != 0, axis=1)
    full = inside & (cells != 32)
    ends = np.where(full.any(axis=1), width - full[:, ::-1].argmax(axis=1), 0)
    null = None if plain else ~inside[:, 0]
    return latin(cells[np.arange(width) < ends[:, None]], ends, null)


def latin(data: np.ndarray, sizes: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Texts of so many Latin-1 bytes each, which follow one another in data."""
    high = data > 127
    if high.any():
        # Two bytes for each above 127, as UTF-8 has them.
        before = np.concatenate([[0], np.cumsum(high)])
        ends = np.cumsum(sizes)
        sizes = sizes + before[ends] - before[ends - sizes]
        wide = np.repeat(data, 1 + high)
        at = np.flatnonzero(high) + before[:-1][high]
        wide[at], wide[at + 1] = 0xC0 | data[high] >> 6, 0x80 | data[high] & 0x3F
        data = wide
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    made = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return (pc.if_else(pa.array(null), pa.scalar(None, pa.large_string()), made) if null is not None and null.any() else made).cast(pa.string())


def nested(flat: pa.Array, dims: list[int], rows: int) -> pa.Array:
    """Lists of fixed lengths around a flat array; the first axis is innermost."""
    for i, n in enumerate(dims):
        outer = rows * int(np.prod(dims[i + 1 :], dtype=np.int64))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(outer + 1, dtype=np.int32) * n), flat)
    return flat


class TableReader(_Reader):
    """Rows of binary and ASCII tables; rownum counts from 0."""

    @classmethod
    def wanted(cls, h: Hdu) -> bool:
        return h.kind in ("binary_table", "ascii_table") and not h.compressed

    @classmethod
    def columns(cls, h: Hdu, plan: dict) -> T.StructType:
        if h.kind not in ("binary_table", "ascii_table"):
            raise errors.WrongHduType(h.kind)
        fields = cls.fields(h)
        if plan["columns"]:
            names, keep = [f.name for f in fields], []
            for p in plan["columns"]:
                found = [n for n in names if re.match(wildcard(p), n)] if set(p) & set("*?#") else [resolve(names, p)]
                keep += [n for n in found if n not in keep]
            fields = [next(f for f in fields if f.name == n) for n in keep]
        own = [f.spark_field() if h.kind == "binary_table" else T.StructField(f.name, cls.ascii_type(f)) for f in fields]
        return T.StructType([T.StructField("rownum", T.LongType()), *own])

    @staticmethod
    def fields(h: Hdu) -> list[Field]:
        """The fields as they read: of a tile-compressed table, those of the table inside."""
        fields = fields_of(h.header)
        if h.header.value("ZTABLE") is True:
            for i, x in enumerate(fields, 1):
                x.code, x.repeat, x.element = parse_binary(h.header.text(f"ZFORM{i}") or "")
                if x.code not in "BIJKED":
                    raise errors.UnsupportedCodec(f"a compressed column of {x.code}")
                x.dims = ()
        return fields

    @staticmethod
    def ascii_type(f: Field) -> T.DataType:
        return {"A": T.StringType(), "I": T.LongType()}.get(f.code, T.DoubleType()) if not f.scaled else T.DoubleType()

    def count(self, h: Hdu) -> int:
        return h.header.integer("ZNAXIS2") if h.header.value("ZTABLE") is True else h.axes[1]

    def batches(self, f, h: Hdu, part: Ranges, step: int = 1 << 16):
        if h.header.value("ZTABLE") is True:
            yield from self.tiles(f, h, part)
            return
        fields = [x for x in fields_of(h.header) if x.name in self.out.names]
        width = h.axes[0]
        for a in range(part.first, part.last + 1, step):
            n = min(step, part.last + 1 - a)
            f.seek(h.data_at + a * width)
            data = np.frombuffer(f.read(n * width), np.uint8)
            if len(data) < n * width:
                raise errors.TruncatedData(part.path)
            rows = data.reshape(n, width)
            made = {"rownum": pa.array(np.arange(a, a + n))}
            for x in fields:
                cell = np.ascontiguousarray(rows[:, x.offset : x.offset + x.width])
                made[x.name] = self.cells(f, h, x, cell, n) if h.kind == "binary_table" else self.texts(x, cell)
            yield self.arrays(made)

    def tiles(self, f, h: Hdu, part: Ranges):
        """Rows of a tile-compressed table: each of its rows holds a tile of every column."""
        total = h.header.integer("ZNAXIS2")
        size = h.header.integer("ZTILELEN", total)
        if size <= 0 or -(-total // size) != h.axes[1]:
            raise errors.BadTile("ZTILELEN")
        places = {x.name: x for x in fields_of(h.header)}
        codec = {x.name: h.header.text(f"ZCTYP{i}", "GZIP_1") for i, x in enumerate(self.fields(h), 1)}
        heap_at = h.header.value("THEAP", h.axes[0] * h.axes[1])
        for t in range(part.first // size, part.last // size + 1):
            n = min(size, total - t * size)
            a, b = max(part.first, t * size), min(part.last, t * size + n - 1)
            f.seek(h.data_at + t * h.axes[0])
            row = np.frombuffer(f.read(h.axes[0]), np.uint8)
            made = {"rownum": pa.array(np.arange(a, b + 1))}
            for x in self.fields(h):
                if x.name not in self.out.names:
                    continue
                if codec[x.name] not in ("GZIP_1", "GZIP_2"):
                    raise errors.UnsupportedCodec(codec[x.name])
                at = places[x.name]
                length, offset = row[at.offset : at.offset + at.width].view(">i4" if at.code == "P" else ">i8").astype(np.int64).tolist()
                if length < 0 or offset < 0 or (length and offset + length > h.pcount - (heap_at - h.axes[0] * h.axes[1])):
                    raise errors.BadDescriptor(x.name)
                kind = np.dtype(NUMPY[x.code])
                f.seek(h.data_at + heap_at + offset)
                values = codecs.decode(codec[x.name], f.read(length), n * x.repeat, kind.newbyteorder("=")) if length else np.zeros(n * x.repeat, kind.newbyteorder("="))
                cell = np.ascontiguousarray(values.astype(kind).reshape(n, x.repeat)[a - t * size : b + 1 - t * size])
                x.width = kind.itemsize * x.repeat
                made[x.name] = self.cells(f, h, x, cell.view(np.uint8).reshape(b + 1 - a, -1), b + 1 - a)
            yield self.arrays(made)

    def cells(self, f, h: Hdu, x: Field, cell: np.ndarray, n: int) -> pa.Array:
        plain = self.plan["raw"]
        if x.element:
            return self.variable(f, h, x, cell, n)
        if x.code == "A":
            if len(x.dims) > 1:
                each = x.dims[0]
                flat = text_array(cell[:, : int(np.prod(x.dims))], each, plain)
                return nested(flat, list(x.dims[1:]), n)
            return text_array(cell, x.repeat, plain)
        if x.code == "X":
            bits = np.unpackbits(cell, axis=1)[:, : x.repeat]
            flat = pa.array(np.ascontiguousarray(bits).ravel().astype(bool))
            return flat if x.repeat == 1 else nested(flat, [x.repeat], n)
        flat = decode_values(cell.ravel().view(NUMPY[x.code]), x, plain)
        if x.dims and len(x.dims) > 1:
            per, used = x.repeat, int(np.prod(x.dims))
            if used < per:
                flat = flat.take(pa.array((np.arange(n)[:, None] * per + np.arange(used)).ravel()))
            return nested(flat, list(x.dims), n)
        return flat if x.repeat == 1 else nested(flat, [x.repeat], n)

    def variable(self, f, h: Hdu, x: Field, cell: np.ndarray, n: int) -> pa.Array:
        """Arrays in the heap: lengths and offsets are checked before anything is read."""
        if x.repeat == 0:
            return pa.array([None] * n, pa.list_(pa.int64()))
        pairs = cell.ravel().view(">i4" if x.code == "P" else ">i8").reshape(n, 2).astype(np.int64)
        heap_at = h.header.value("THEAP", h.axes[0] * h.axes[1])
        heap_size = h.pcount - (heap_at - h.axes[0] * h.axes[1])
        bits = x.element == "X"
        sizes = -(-pairs[:, 0] // 8) if bits else pairs[:, 0] * width_of(x.element, 1)
        used = pairs[:, 0] > 0
        if (pairs[:, 0] < 0).any() or (pairs[used, 1] < 0).any() or (pairs[used, 1] + sizes[used] > heap_size).any() or (sizes > LIMITS["vla"] * 16).any():
            raise errors.BadDescriptor(x.name)
        raw = gather(f, h.data_at + heap_at, pairs[:, 1], sizes)
        if x.element == "A":
            ends = np.cumsum(sizes)
            return self.heap_texts(raw, sizes, ends)
        if bits:
            spread, starts = np.unpackbits(raw), 8 * (np.cumsum(sizes) - sizes)
            ends = np.cumsum(pairs[:, 0])
            flat = pa.array(spread[np.repeat(starts - ends + pairs[:, 0], pairs[:, 0]) + np.arange(pairs[:, 0].sum())].astype(bool))
        else:
            own = Field(x.name, x.element, 1, 0, 0, scale=x.scale, zero=x.zero)  # heap values have no null
            flat = decode_values(raw.view(NUMPY[x.element]), own, self.plan["raw"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pairs[:, 0])]).astype(np.int32)), flat)

    @staticmethod
    def heap_texts(raw: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts in the heap: each up to its first NUL, without trailing blanks."""
        owner, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(raw))
        stop = np.full(len(sizes), len(raw))
        np.minimum.at(stop, owner[raw == 0], place[raw == 0])
        stop = np.minimum(stop, ends)
        last = ends - sizes
        full = (raw != 32) & (place < stop[owner])
        np.maximum.at(last, owner[full], place[full] + 1)
        return latin(raw[place < last[owner]], last - (ends - sizes))

    def texts(self, x: Field, cell: np.ndarray) -> pa.Array:
        """Values of an ASCII field; Arrow reads what is plainly written, the rest is read one by one."""
        blank = " \0"
        raw = latin(cell.ravel(), np.full(len(cell), cell.shape[1]))
        trimmed = pc.utf8_trim(raw, blank)
        null = pc.equal(trimmed, "")
        if isinstance(x.null, str):
            null = pc.or_(null, pc.equal(trimmed, x.null.strip(blank)))
        if x.code == "A":
            return pc.if_else(null, pa.scalar(None, pa.string()), pc.utf8_rtrim(raw, blank))
        whole = x.code == "I"
        kind = pa.int64() if whole else pa.float64()
        text = pc.if_else(null, pa.scalar(None, pa.string()), trimmed)
        plain = pc.match_substring_regex(text, r"^-?\d{1,18}$" if whole else r"^-?(\d+\.\d*|\.\d+)([ED][+-]?\d{1,4})?$")
        read = pc.cast(pc.replace_substring(pc.if_else(plain, text, pa.scalar(None, pa.string())), "D", "E"), kind)
        rest = np.flatnonzero(pc.fill_null(pc.invert(plain), False).to_numpy(zero_copy_only=False))
        if len(rest):
            values = [ascii_integer(t) if whole else ascii_real(t, x.decimals) for t in text.take(pa.array(rest)).to_pylist()]
            read = pc.replace_with_mask(read, pa.array(np.isin(np.arange(len(read)), rest)), pa.array(values, kind))
        if not whole and pc.any(pc.is_inf(read)).as_py():
            raise errors.NonFinite(x.name)
        return pc.add(x.zero, pc.multiply(x.scale, read.cast(pa.float64()))) if x.scaled else read


def gather(f, at: int, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of pieces of a file, one after the other; pieces that lie close together are read at once."""
    own = np.flatnonzero(sizes)
    order = own[np.argsort(offsets[own], kind="stable")]
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    reach = np.maximum.accumulate((offsets + sizes)[order]) if len(order) else offsets[:0]
    cuts = np.flatnonzero(offsets[order][1:] > reach[:-1] + GAP) + 1
    for run in np.split(order, cuts):
        if not len(run):
            continue
        low, high = int(offsets[run[0]]), int((offsets[run] + sizes[run]).max())
        f.seek(at + low)
        data = np.frombuffer(f.read(high - low), np.uint8)
        if len(data) < high - low:
            raise errors.TruncatedData(f"byte {at + low}")
        n = sizes[run]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat((ends - sizes)[run], n) + inner] = data[np.repeat(offsets[run] - low, n) + inner]
    return out


def ascii_integer(text: str) -> int:
    t = text.strip()
    if not re.fullmatch(r"[+-]?\d+", t):
        raise errors.BadValue(text)
    return int(t)


def ascii_real(text: str, decimals: int = 0) -> float:
    """A FORTRAN number: an implied point, an exponent by E or D or a bare sign."""
    m = re.fullmatch(r"([+-]?)(\d*)(?:(\.)(\d*))?(?:[EeDd]([+-]?\d+)|([+-]\d+))?", text.strip())
    if not m or not (m[2] or m[4]):
        raise errors.BadValue(text)
    shift = len(m[4]) if m[3] else decimals
    v = float(f"{m[1]}{m[2]}{m[4] or ''}e{int(m[5] or m[6] or 0) - shift}")
    if v in (float("inf"), float("-inf")):
        raise errors.NonFinite(text)
    return v


_BITPIX = {8: "B", 16: "I", 32: "J", 64: "K", -32: "E", -64: "D"}


class ImageReader(_Reader):
    """Pixels: pix (from 0, the first axis fastest), their coordinates c1, c2, ... from 0, and value."""

    @classmethod
    def wanted(cls, h: Hdu) -> bool:
        return (h.kind in ("primary", "image") and bool(h.axes)) or h.compressed

    @classmethod
    def field(cls, h: Hdu) -> Field:
        get = h.header.real
        code = _BITPIX[h.header.integer("ZBITPIX") if h.compressed else h.bitpix]
        return Field("value", code, 1, 0, 0, scale=get("BSCALE", 1.0), zero=whole_or_real(h.header, "BZERO"), null=h.header.value("BLANK"))

    @classmethod
    def shape(cls, h: Hdu) -> list[int]:
        if h.compressed:
            return [h.header.integer(f"ZNAXIS{i}") for i in range(1, h.header.integer("ZNAXIS") + 1)]
        return h.axes

    @classmethod
    def columns(cls, h: Hdu, plan: dict) -> T.StructType:
        if not cls.wanted(h):
            raise errors.WrongHduType(h.kind)
        x = cls.field(h)
        own = x.spark_type()
        if h.compressed and h.header.has("ZQUANTIZ") or (h.compressed and x.code in "ED"):
            own = T.DoubleType() if x.code == "D" or x.scaled else T.FloatType()
        coords = [T.StructField(f"c{i + 1}", T.LongType()) for i in range(len(cls.shape(h)))]
        return T.StructType([T.StructField("pix", T.LongType()), *coords, T.StructField("value", own)])

    def count(self, h: Hdu) -> int:
        shape = self.shape(h)
        n = int(np.prod(shape, dtype=object)) if shape else 0
        if n > LIMITS["pixels"]:
            raise errors.LimitExceeded("pixels")
        return n

    def units(self, h: Hdu) -> tuple[int, int]:
        """Tiles of a compressed image, lines of a section, pixels else."""
        shape, section = self.shape(h), self.plan["section"]
        count = self.count(h)
        if section and self.plan["rows"]:
            raise errors.BadSection("rows and a section")
        if h.compressed:
            return 0, len(self.tiles(h)) - 1
        if section:
            return 0, int(np.prod(self.lines(shape)[0])) - 1
        return self.bounds(count)

    def step(self, h: Hdu) -> int:
        size = self.plan["size"]
        if h.compressed:
            return max(1, size // max(1, int(np.prod(tiling(h)[1]))))
        if self.plan["section"]:
            return max(1, size // self.lines(self.shape(h))[1])
        return max(1, size)

    def lines(self, shape: list[int]) -> tuple[list[int], int]:
        """How a section is read: pieces of a line and lines along each other axis, and pixels of a piece."""
        low, high, step = filespec.resolve(self.plan["section"], shape)
        counts = [(b - a) // s + 1 for a, b, s in zip(low, high, step, strict=True)]
        piece = min(counts[0], LINE_PIXELS)
        return [-(-counts[0] // piece), *counts[1:]], piece

    def tiles(self, h: Hdu) -> np.ndarray:
        """The numbers of the tiles that may hold pixels of the section or of the rows."""
        shape, tile, counts = tiling(h)
        if self.plan["section"]:
            low, high, _ = filespec.resolve(self.plan["section"], shape)
        else:
            first, last = self.bounds(self.count(h))
            low, high, step = [0] * len(shape), [n - 1 for n in shape], int(np.prod(shape, dtype=object))
            for i in reversed(range(len(shape))):  # the slowest axis first, as long as first and last share a place
                step //= shape[i]
                low[i], high[i] = first // step, last // step
                if low[i] != high[i]:
                    break
                first, last = first % step, last % step
        found, size = np.zeros(1, np.int64), 1
        for a, b, t, n in zip(low, high, tile, counts, strict=True):
            found = (np.arange(a // t, b // t + 1)[:, None] * size + found).ravel()
            size *= n
        return found

    def batches(self, f, h: Hdu, part: Ranges, step: int = 1 << 18):
        shape, x = self.shape(h), self.field(h)
        if h.compressed:
            yield from self.from_tiles(f, h, part, shape, x)
            return
        kind = np.dtype(NUMPY[x.code])
        if self.plan["section"]:
            yield from self.from_lines(f, h, part, shape, x, kind, step)
            return
        for a in range(part.first, part.last + 1, step):
            n = min(step, part.last + 1 - a)
            f.seek(h.data_at + a * kind.itemsize)
            raw = np.frombuffer(f.read(n * kind.itemsize), kind)
            if len(raw) < n:
                raise errors.TruncatedData(part.path)
            yield self.pixels(np.arange(a, a + n), decode_values(raw, x, self.plan["raw"]), shape)

    def from_lines(self, f, h: Hdu, part: Ranges, shape: list[int], x: Field, kind: np.dtype, step: int):
        """Pixels of a section: only its lines, or pieces of them, are read."""
        low, high, stride = filespec.resolve(self.plan["section"], shape)
        counts, piece = self.lines(shape)
        many = max(1, step // piece)
        for a in range(part.first, part.last + 1, many):
            own = np.arange(a, min(a + many, part.last + 1))
            first = low[0] + own % counts[0] * piece * stride[0]
            rest, base, size = own // counts[0], np.zeros(len(own), np.int64), shape[0]
            for b, s, n, m in zip(low[1:], stride[1:], counts[1:], shape[1:], strict=True):
                base += (b + rest % n * s) * size
                rest, size = rest // n, size * m
            taken = np.minimum(piece, (high[0] - first) // stride[0] + 1)
            span = (taken - 1) * stride[0] + 1
            raw = gather(f, h.data_at, (base + first) * kind.itemsize, span * kind.itemsize).view(kind)
            inner = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
            values = raw[np.repeat(np.cumsum(span) - span, taken) + inner * stride[0]]
            yield self.pixels(np.repeat(base + first, taken) + inner * stride[0], decode_values(values, x, self.plan["raw"]), shape)

    def pixels(self, pix: np.ndarray, values: pa.Array, shape: list[int]) -> pa.RecordBatch:
        coords, rest = [], pix
        for n in shape:
            coords.append(rest % n)
            rest = rest // n
        made = {f"c{i + 1}": c for i, c in enumerate(coords)} | {"pix": pix}
        if self.plan["section"]:
            low, high, step = filespec.resolve(self.plan["section"], shape)
            keep = np.ones(len(pix), bool)
            out, size = np.zeros(len(pix), np.int64), 1
            for c, a, b, s in zip(coords, low, high, step, strict=True):
                keep &= (c >= a) & (c <= b) & ((c - a) % s == 0)
                out += (c - a) // s * size
                size *= (b - a) // s + 1
            made["pix"] = out
            made = {k: v[keep] for k, v in made.items()}
            values = values.filter(pa.array(keep))
        return self.arrays({k: pa.array(v) for k, v in made.items()} | {"value": values})

    def from_tiles(self, f, h: Hdu, part: Ranges, shape, x: Field):
        """Pixels of the tiles of a partition; each tile is decoded by one task, once."""
        numbers = self.tiles(h)[part.first : part.last + 1]
        first, last = self.bounds(self.count(h))
        for tile in read_tiles(f, h, numbers.tolist()):
            values, origin, size = tile["pixels"], tile["origin"], tile["size"]
            index = np.indices(size[::-1]).reshape(len(size), -1)[::-1]  # the first axis fastest
            pix, step = np.zeros(index.shape[1], np.int64), 1
            for c, o, n in zip(index, origin, shape, strict=True):
                pix += (c + o) * step
                step *= n
            keep = (pix >= first) & (pix <= last)
            if keep.any():
                own = values[keep]
                if own.dtype.kind == "f":
                    v = pa.array(x.zero + x.scale * own if x.scaled else own)
                else:
                    v = decode_values(own, x, self.plan["raw"])
                yield self.pixels(pix[keep], v, shape)


def tiling(h: Hdu) -> tuple[list[int], list[int], list[int]]:
    """The axes of a compressed image, of a tile, and the number of tiles along each axis."""
    shape = ImageReader.shape(h)
    tile = [h.header.integer(f"ZTILE{i + 1}", shape[0] if i == 0 else 1) for i in range(len(shape))]
    if any(t <= 0 for t in tile):
        raise errors.BadTile(str(tile))
    counts = [-(-n // t) for n, t in zip(shape, tile, strict=True)]
    if int(np.prod(counts)) != h.axes[1]:
        raise errors.BadTile(f"{counts} tiles in {h.axes[1]} rows")
    return shape, tile, counts


def read_tiles(f, h: Hdu, numbers):
    """Decoded tiles of a compressed image: number, origin, size (first axis first) and pixels, flat."""
    head = h.header
    shape, tile, counts = tiling(h)
    fields = {x.name: x for x in fields_of(head)}
    bitpix, codec = head.integer("ZBITPIX"), head.text("ZCMPTYPE")
    params = {head.text(f"ZNAME{i}"): head.value(f"ZVAL{i}") for i in range(1, 10) if head.has(f"ZNAME{i}")}
    method, seed = head.text("ZQUANTIZ"), head.value("ZDITHER0", 1)
    if bitpix < 0 and method not in (None, "NONE", "NO_DITHER", "SUBTRACTIVE_DITHER_1", "SUBTRACTIVE_DITHER_2"):
        raise errors.UnsupportedCodec(str(method))
    for r in numbers:
        f.seek(h.data_at + r * h.axes[0])
        row = np.frombuffer(f.read(h.axes[0]), np.uint8)

        def bytes_of(name, row=row):
            x = fields.get(name)
            if x is None:
                return None
            pair = row[x.offset : x.offset + x.width].view(">i4" if x.code == "P" else ">i8")
            n, at = int(pair[0]), int(pair[1])
            if n == 0:
                return None
            heap = head.value("THEAP", h.axes[0] * h.axes[1])
            size = width_of(x.element, n)
            if n < 0 or at < 0 or at + size > h.pcount - (heap - h.axes[0] * h.axes[1]):
                raise errors.BadDescriptor(name)
            f.seek(h.data_at + heap + at)
            return f.read(size)

        def number(name, default, row=row):
            x = fields.get(name)
            if x is not None:
                return row[x.offset : x.offset + x.width].view(NUMPY[x.code])[0]
            return head.value(name, default)

        place, origin, size = r, [], []
        for n, t, c in zip(shape, tile, counts, strict=True):
            origin.append(place % c * t)
            size.append(min(t, n - place % c * t))
            place //= c
        count = int(np.prod(size))
        stored = np.dtype({8: "u1", 16: "i2", 32: "i4", 64: "i8", -32: "f4", -64: "f8"}[bitpix])
        quantized = bitpix < 0 and method not in (None, "NONE") or (bitpix < 0 and "ZSCALE" in fields)
        data = bytes_of("COMPRESSED_DATA")
        if data is not None:
            kind = np.dtype("i4") if quantized else stored
            values = codecs.decode(codec, data, count, kind, int(params.get("BLOCKSIZE", 32) or 32))
            if quantized:
                draws = codecs.dither(r + 1, count, int(seed)) if method and method.startswith("SUBTRACTIVE") else None
                null = number("ZBLANK", codecs.NULL_CODE)
                values = codecs.unquantize(values, float(number("ZSCALE", 1.0)), float(number("ZZERO", 0.0)), draws, method == "SUBTRACTIVE_DITHER_2", int(null)).astype(stored)
        elif (data := bytes_of("GZIP_COMPRESSED_DATA")) is not None:
            values = codecs.decode("GZIP_1", data, count, stored)
        elif (data := bytes_of("UNCOMPRESSED_DATA")) is not None:
            values = np.frombuffer(data, stored.newbyteorder(">")).astype(stored)
        else:
            values = np.zeros(count, stored)
        yield {"tile": r, "origin": origin, "size": size, "pixels": values}


class TilesReader(_Reader):
    """A row for each tile of a compressed image: tile, start, shape and its values as doubles."""

    @classmethod
    def wanted(cls, h: Hdu) -> bool:
        return h.compressed

    @classmethod
    def columns(cls, h: Hdu, plan: dict) -> T.StructType:
        if not h.compressed:
            raise errors.WrongHduType(h.kind)
        return struct("tile bigint, start array<bigint>, shape array<bigint>, data array<double>")

    def count(self, h: Hdu) -> int:
        return h.axes[1]

    def step(self, h: Hdu) -> int:
        return max(1, self.plan["size"] // max(1, int(np.prod(tiling(h)[1]))))

    def batches(self, f, h: Hdu, part: Ranges):
        for t in read_tiles(f, h, range(part.first, part.last + 1)):
            own = t["pixels"].astype("f8")
            data = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))
            yield self.arrays({"tile": pa.array([t["tile"]]), "start": pa.array([t["origin"]]), "shape": pa.array([t["size"]]), "data": data})


class GroupsReader(_Reader):
    """A row for each group: group (from 0), params and data, both scaled."""

    @classmethod
    def wanted(cls, h: Hdu) -> bool:
        return h.kind == "random_groups"

    @classmethod
    def columns(cls, h: Hdu, plan: dict) -> T.StructType:
        if h.kind != "random_groups":
            raise errors.WrongHduType(h.kind)
        return struct("group bigint, params array<double>, data array<double>")

    def count(self, h: Hdu) -> int:
        return h.gcount

    @staticmethod
    def values_of(h: Hdu) -> int:
        """Numbers in a group."""
        return h.pcount + int(np.prod(h.axes[1:], dtype=np.int64))

    def step(self, h: Hdu) -> int:
        return max(1, self.plan["size"] // max(1, self.values_of(h)))

    def batches(self, f, h: Hdu, part: Ranges):
        kind, head, size = np.dtype(NUMPY[_BITPIX[h.bitpix]]), h.header, self.values_of(h)
        scale = np.array([head.real(f"PSCAL{i + 1}", 1.0) for i in range(h.pcount)])
        zero = np.array([head.real(f"PZERO{i + 1}", 0.0) for i in range(h.pcount)])
        x, many = ImageReader.field(h), max(1, (1 << 18) // max(1, size))
        lists = lambda v, mask=None: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel(), mask=mask))
        for a in range(part.first, part.last + 1, many):
            n = min(many, part.last + 1 - a)
            f.seek(h.data_at + a * size * kind.itemsize)
            raw = np.frombuffer(f.read(n * size * kind.itemsize), kind)
            if len(raw) < n * size:
                raise errors.TruncatedData(part.path)
            raw = raw.reshape(n, size)
            stored = raw[:, h.pcount :]
            mask = (stored == x.null).ravel() if isinstance(x.null, int) and h.bitpix > 0 else None
            params, data = zero + scale * raw[:, : h.pcount].astype("f8"), float(x.zero) + x.scale * stored.astype("f8")
            yield self.arrays({"group": pa.array(np.arange(a, a + n)), "params": lists(params), "data": lists(data, mask)})


READERS = {"hdus": HdusReader, "cards": CardsReader, "table": TableReader, "image": ImageReader, "tiles": TilesReader, "groups": GroupsReader}


def register(spark: SparkSession) -> SparkSession:
    """Make ``spark.read.format("fits")`` and ``df.write.format("fits")`` work in a session."""
    spark.dataSource.register(FitsSource)
    return spark
