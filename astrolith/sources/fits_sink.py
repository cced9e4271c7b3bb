"""Writing FITS files: tables and images from DataFrames, published by one rename.

Each task encodes its rows into part files beside the target, in a folder that the driver and the
executors share; the driver then lays out header, rows and heap in partition order, adds checksums
if asked for, and renames the file into place.  A failed job leaves the target as it was.

Options: ``path``, ``mode`` (table, ascii, image, groups, or update: pixels of an existing image),
``extname``, ``axes`` (of an image, between commas), ``checksum``, ``widths`` (of texts: name:width
between commas; else metadata, else 32), ``header`` (a JSON list of [keyword, value, comment]),
``append`` (true: one more HDU to an existing file), ``hdu`` (of update), ``files`` (true: the path is a
folder, and each task writes a table file of its own there, so that the driver copies nothing).  A path
that ends in .gz is written as a whole-file gzip.

Scaled columns are stored as integers: ``scaled`` has name:code:scale:zero between commas, or is
``keep`` for columns that still have the metadata with which they were read.  Images and groups have
``bitpix``, ``bscale`` and ``bzero``, groups also ``pscal`` and ``pzero`` between commas.  Values are
rounded half away from zero; what does not fit is an error.

Nothing is lost without an error.  Nulls of integers are stored as the type's least number (the
greatest for unsigned 64-bit ones), or as what ``nulls`` says (name:stored between commas), with a
TNULL or BLANK card; if that number is a value too, it is an error.  Nulls of real numbers are NaN.
A null array is an empty one; null integers inside an array, and characters that are not Latin-1, are
errors.  Descriptors are 64-bit ones if the heap needs them.
"""

from __future__ import annotations

import dataclasses
import gzip
import json
import os
import shutil
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from .. import errors
from ..functions import arrays
from ..functions.checksum import ALL_ONES, encode_number
from . import codecs, integrity
from .header import BLOCK, Header, make_hdu, scan
from .schema import NUMPY, WHOLE_DIGITS

_SCALARS = {"boolean": "L", "tinyint": "B", "smallint": "I", "int": "J", "bigint": "K", "float": "E", "double": "D", "string": "A", "decimal(20,0)": "K", "binary": "B"}
_CODES = {8: "B", 16: "I", 32: "J", 64: "K", -32: "E", -64: "D"}
#: The largest heap that 32-bit descriptors reach.
NARROW_HEAP = (1 << 31) - 1
_IMAGE = {"smallint": 16, "int": 32, "bigint": 64, "float": -32, "double": -64, "tinyint": 8}


def card(name: str, value=None, comment: str | None = None) -> bytes:
    """One card; longer texts go on in CONTINUE cards."""
    if name in ("COMMENT", "HISTORY", ""):
        return "".join(f"{name:<8}{str(value)[a : a + 72]}".ljust(80) for a in range(0, max(1, len(str(value))), 72)).encode("latin-1")
    if isinstance(value, str):
        inner, room = value.replace("'", "''"), 68 if len(name) <= 8 else 62 - len(name)
        if len(inner) > room:
            out, rest, first = "", inner, True
            while rest or first:
                cut = min(67, len(rest))
                while rest[:cut].count("'") % 2:  # not between two that stand for one
                    cut -= 1
                part, rest = rest[:cut], rest[cut:]
                out += (f"{name:<8}= '" if first else "CONTINUE  '") + part + ("&" if rest else "") + "'"
                out = out.ljust(-(-len(out) // 80) * 80)
                first = False
            return out.encode("latin-1")
        text = f"'{inner:<8}'"
    elif value is None:
        text = ""
    elif isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, complex):
        text = f"({real(value.real)}, {real(value.imag)})"
    else:
        text = f"{real(value) if isinstance(value, float) else value:>20}"
    out = f"HIERARCH {name} = {text}" if len(name) > 8 or " " in name else f"{name:<8}= {text}"
    if len(out) > 80:
        raise errors.CardOverflow(out)
    return (out + (f" / {comment}" if comment else ""))[:80].ljust(80).encode("latin-1")


def real(x: float) -> str:
    """A real number with a point or an exponent, in capitals."""
    t = repr(float(x)).upper()
    return t if "." in t or "E" in t else t + ".0"


@dataclasses.dataclass
class Out:
    """A column as it is written: stored = (value - zero) / scale."""

    name: str
    code: str
    repeat: int = 1
    variable: bool = False
    zero: float = 0
    scale: float = 1.0
    null: int | None = None  # what is stored for null

    def form(self, wide: bool) -> str:
        return f"1{'Q' if wide else 'P'}{self.code}" if self.variable else f"{self.repeat}{self.code}"

    @property
    def width(self) -> int:
        """Bytes in a part file, where descriptors are 64-bit ones."""
        return 16 if self.variable else int(np.dtype(NUMPY[self.code]).itemsize) * self.repeat * (2 if self.code in "CM" else 1)


def least(code: str) -> int | None:
    """The least number that is stored as code."""
    return int(np.iinfo(NUMPY[code]).min) if code in "BIJK" else None


def outs(schema: T.StructType, widths: dict[str, int], nulls: dict[str, int], scaled: dict[str, tuple[str, float, float]]) -> list[Out]:
    """The columns of a schema; rownum is left out."""
    found = []
    for f in schema.fields:
        kind, variable = f.dataType.simpleString(), False
        if f.name == "rownum":
            continue
        if kind.startswith("array<") or kind == "binary":
            kind, variable = (kind[6:-1] if kind != "binary" else "binary"), True
        if f.name in scaled and not variable and kind in ("float", "double", "tinyint", "smallint", "int", "bigint"):
            code, scale, zero = scaled[f.name]
            found.append(Out(f.name, code, 1, False, zero, scale, least(code)))
        elif kind in ("struct<re:float,im:float>", "struct<re:double,im:double>"):
            found.append(Out(f.name, "C" if "float" in kind else "M", 1, variable))
        elif kind == f"decimal({WHOLE_DIGITS},0)" and f.metadata.get("zero") is not None:
            found.append(Out(f.name, "K", 1, variable, int(f.metadata["zero"]), null=least("K")))
        elif kind in _SCALARS and not (variable and kind == "string"):
            width = widths.get(f.name, f.metadata.get("repeat", 32)) if kind == "string" else 1
            zero, code = {"tinyint": -128, "decimal(20,0)": 1 << 63}.get(kind, 0), _SCALARS[kind]
            found.append(Out(f.name, code, width, variable, zero, null=(1 << 63) - 1 if zero == 1 << 63 else least(code)))
        else:
            raise errors.BadTform(f"{f.name}: {kind}")
        found[-1].null = nulls.get(f.name, found[-1].null)
    return found


class Seen(dict):
    """By column: whether nulls were written, and whether the number that stands for them was a value."""

    def add(self, o: Out, null: bool, value: bool) -> None:
        before = self.get(o.name, (False, False))
        self[o.name] = (before[0] or null, before[1] or value)


def null_of(o: Out, seen: list[dict]) -> int | None:
    """What stands for null in a column, if any task wrote nulls."""
    if not any(s.get(o.name, (False, False))[0] for s in seen):
        return None
    if any(s.get(o.name, (False, False))[1] for s in seen):
        raise errors.BadValue(f"{o.name}: {o.null} stands for null and is a value too; name another number with the option nulls")
    return o.null


def integers(values: pa.Array, o: Out) -> np.ndarray:
    """Whole numbers less the column's zero point, as they are stored; 0 for null."""
    if pa.types.is_decimal(values.type):
        own = np.array([0 if v is None else int(v) - int(o.zero) for v in values.to_pylist()], object)
    else:
        own = values.fill_null(0).to_numpy(zero_copy_only=False)
        own = own.astype("i8") - int(o.zero) if o.zero else own
    limits = np.iinfo(NUMPY[o.code])
    if len(own) and (own.min() < limits.min or own.max() > limits.max):
        raise errors.Overflow(o.name)
    return own.astype(NUMPY[o.code])


def scaled_integers(values: pa.Array, o: Out, null: np.ndarray) -> np.ndarray:
    """Real numbers as stored integers; null gets the places of nulls and NaN."""
    x = (values.cast(pa.float64()).to_numpy(zero_copy_only=False) - float(o.zero)) / o.scale
    null |= np.isnan(x)
    x = np.where(null, 0.0, x)
    whole = np.copysign(np.floor(np.abs(x) + 0.5), x)
    limits = np.iinfo(NUMPY[o.code])
    # The greatest 64-bit number is no double: the comparison is with the next one.
    if (whole < float(limits.min)).any() or (whole >= float(limits.max) + 1).any():
        raise errors.Overflow(o.name)
    return whole.astype(NUMPY[o.code])


def flat_bytes(values: pa.Array, o: Out, seen: Seen) -> np.ndarray:
    """Elements as they stand on disk."""
    if o.code in "CM":
        kind = ">f4" if o.code == "C" else ">f8"
        both = [part.to_numpy(zero_copy_only=False).astype("f8") for part in values.flatten()]  # a null is NaN in both parts
        return np.stack(both, axis=1).ravel().astype(kind)
    if o.code == "L":
        known = values.fill_null(False).to_numpy(zero_copy_only=False)
        return np.where(values.is_null().to_numpy(zero_copy_only=False), 0, np.where(known, 84, 70)).astype(np.uint8)
    if o.code in "ED":
        return values.to_numpy(zero_copy_only=False).astype(NUMPY[o.code])
    null = values.is_null().to_numpy(zero_copy_only=False).copy()
    real = o.scale != 1.0 or isinstance(o.zero, float)
    stored = scaled_integers(values, o, null) if real else integers(values, o)
    if o.variable and null.any():
        raise errors.BadValue(f"{o.name}: a null inside an array of integers")
    if o.null is None and null.any():
        raise errors.BadValue(f"{o.name}: nothing stands for null")
    if o.null is not None:
        limits = np.iinfo(NUMPY[o.code])
        if not limits.min <= o.null <= limits.max:
            raise errors.Overflow(f"{o.name}: {o.null} stands for null")
        seen.add(o, bool(null.any()), bool((stored[~null] == o.null).any()))
        stored[null] = o.null
    return stored


def text_bytes(values: pa.Array, width: int, name: str, blank: bool = False) -> np.ndarray:
    """Texts as rows of width bytes, filled up with blanks; nulls are zeros, or blanks."""
    n, null = len(values), values.is_null().to_numpy(zero_copy_only=False)
    plain = values.fill_null("")
    try:
        own = plain.cast(pa.binary()) if pc.all(pc.string_is_ascii(plain)).as_py() in (True, None) else pa.array([t.encode("latin-1") for t in plain.to_pylist()], pa.binary())
    except UnicodeEncodeError as e:
        raise errors.BadValue(f"{name}: {e.object[e.start : e.end]!r} is no Latin-1 character") from None
    sizes = pc.binary_length(own).to_numpy(zero_copy_only=False)
    if sizes.max(initial=0) > width:
        raise errors.FieldOverflow(f"{name}: {sizes.max()} characters in {width}")
    raw = np.full((n, width), 32, np.uint8)
    offsets = np.frombuffer(own.buffers()[1], np.int32, n + 1, 4 * own.offset) if n else np.zeros(1, np.int32)
    data = np.frombuffer(own.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if own.buffers()[2] is not None else np.zeros(0, np.uint8)
    raw[np.arange(width) < sizes[:, None]] = np.where(data == 0, 32, data)
    if not blank:
        raw[null] = 0
    return raw


def encode_rows(batch: pa.RecordBatch, columns: list[Out], heap, seen: Seen) -> bytes:
    """The rows of a batch; variable arrays go to heap, with 64-bit offsets from its beginning."""
    n, parts = batch.num_rows, []
    for o in columns:
        v = batch.column(o.name)
        if o.variable:
            lists = [b"" if x is None else x for x in v.to_pylist()] if pa.types.is_binary(v.type) else None
            if lists is not None:
                sizes, blob = np.array([len(x) for x in lists], np.int64), b"".join(lists)
            else:
                v = v.fill_null([]) if v.null_count else v
                sizes = np.array(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                blob = flat_bytes(v.flatten(), o, seen).tobytes()
            element = int(np.dtype(NUMPY[o.code]).itemsize) * (2 if o.code in "CM" else 1)
            ends = np.cumsum(sizes * element)
            at = heap.tell() + ends - sizes * element
            heap.write(blob)
            pairs = np.stack([sizes, np.where(sizes > 0, at, 0)], axis=1)
            parts.append(pairs.astype(">i8").view(np.uint8).reshape(n, 16))
        elif o.code == "A":
            parts.append(text_bytes(v, o.repeat, o.name))
        else:
            parts.append(flat_bytes(v, o, seen).view(np.uint8).reshape(n, o.width))
    return np.concatenate(parts, axis=1).tobytes() if parts else b""


def text_column(f: T.StructField, width: int) -> tuple[str, str, int]:
    """(name, format, width) of an ASCII column."""
    kind = f.dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        w = width or 20
        return f.name, f"I{w}", w
    if kind in ("float", "double"):
        w = width or 25
        return f.name, f"E{w}.{max(1, w - 9)}", w
    if kind == "string":
        w = width or f.metadata.get("repeat", 32)
        return f.name, f"A{w}", w
    raise errors.BadTform(f"{f.name}: {kind}")


def encode_texts(batch: pa.RecordBatch, columns) -> bytes:
    """The rows of an ASCII table: numbers to the right, texts to the left, nulls blank."""
    fields = []
    for name, form, w in columns:
        values = batch.column(name).to_pylist()
        if form[0] == "A":
            own = [bytes(row) for row in text_bytes(batch.column(name), w, name, True)]
        elif form[0] == "I":
            own = [("" if v is None else str(v)).encode().rjust(w) for v in values]
        else:
            digits = int(form.split(".")[1])
            own = [("" if v is None else f"{v:.{digits}E}").encode().rjust(w) for v in values]
        if any(len(x) > w for x in own):
            raise errors.FieldOverflow(name)
        fields.append(own)
    return b"".join(b" ".join(row) for row in zip(*fields, strict=True))


@dataclasses.dataclass
class Part(WriterCommitMessage):
    """What a task wrote."""

    number: int
    name: str
    rows: int
    heap: int
    seen: dict


class FitsWriter(DataSourceArrowWriter):
    """See the module."""

    def __init__(self, options, schema: T.StructType, overwrite: bool):
        self.options, self.schema, self.overwrite = dict(options), schema, overwrite
        self.path = self.options["path"].removeprefix("file://").removeprefix("file:")
        self.mode = self.options.get("mode", "table")
        self.parts = f"{self.path.rstrip('/')}.parts-{uuid.uuid4().hex}"
        self.files = self.options.get("files", "false").lower() == "true"
        if self.files and (self.mode not in ("table", "ascii") or self.options.get("append", "false").lower() == "true"):
            raise errors.WrongHduType("files are of tables, and not appended to")
        pairs = lambda name: dict(x.split(":") for x in self.options[name].split(",")) if name in self.options else {}
        widths, nulls = pairs("widths"), {k: int(v) for k, v in pairs("nulls").items()}
        get = lambda name, default: float(self.options.get(name, default))
        if self.mode == "table":
            self.columns = outs(schema, {k: int(v) for k, v in widths.items()}, nulls, self.scalings())
        elif self.mode == "ascii":
            self.columns = [text_column(f, int(widths.get(f.name, 0))) for f in schema.fields if f.name != "rownum"]
        elif self.mode == "groups":
            self.axes = [int(x) for x in self.options["axes"].split(",")]
            self.bitpix = int(self.options.get("bitpix", -64))
            self.column = scaled_column("data", self.bitpix, get("bscale", 1.0), get("bzero", 0.0), nulls.get("data"))
            self.params = [[float(x) for x in self.options[k].split(",")] if k in self.options else [] for k in ("pscal", "pzero")]
        elif self.mode == "image":
            self.axes = [int(x) for x in self.options["axes"].split(",")]
            kind = schema["value"].dataType.simpleString()
            if kind not in _IMAGE:
                raise errors.BadBitpix(kind)
            self.bitpix = int(self.options.get("bitpix", _IMAGE[kind]))
            if {"bitpix", "bscale", "bzero"} & set(self.options):
                self.column = scaled_column("value", self.bitpix, get("bscale", 1.0), get("bzero", 0.0), nulls.get("value"))
            else:
                code = _CODES[self.bitpix]
                self.column = Out("value", code, zero=-128 if kind == "tinyint" else 0, null=nulls.get("value", least(code)))
        elif self.mode == "update":
            with open(self.path, "rb") as f:
                h = next((h for h in scan(f, f.seek(0, 2)) if h.number == int(self.options.get("hdu", 1))), None)
            if h is None or h.kind not in ("primary", "image"):
                raise errors.WrongHduType("no image to update")
            self.target, zero = h, h.header.value("BZERO", 0)
            scale = h.header.real("BSCALE", 1.0)
            whole = scale == 1.0 and float(zero).is_integer() and schema["value"].dataType.simpleString() not in ("float", "double")
            self.column = Out("value", _CODES[h.bitpix], zero=int(zero) if whole else float(zero), scale=scale, null=h.header.value("BLANK") if h.bitpix > 0 else None)
        else:
            raise errors.WrongHduType(self.mode)

    def scalings(self) -> dict[str, tuple[str, float, float]]:
        """(code, scale, zero) by column, from the options or from what the columns were read with."""
        said, found = self.options.get("scaled", ""), {}
        if said == "keep":
            for f in self.schema.fields:
                code, scale, zero = (f.metadata.get(k) for k in ("code", "scale", "zero"))
                if code in ("B", "I", "J", "K") and f.dataType.simpleString() == "double" and scale is not None:
                    found[f.name] = (code, float(scale), float(zero or 0))
            return found
        for x in said.split(",") if said else []:
            name, code, scale, zero = x.split(":")
            if code not in ("B", "I", "J", "K") or float(scale) == 0:
                raise errors.BadTform(x)
            found[name] = (code, float(scale), float(zero))
        return found

    def write(self, iterator):
        context = TaskContext.get()
        name = f"{self.parts}/{context.partitionId():06d}-{context.taskAttemptId()}"
        os.makedirs(self.parts, exist_ok=True)
        rows, seen = 0, Seen()
        with open(f"{name}.rows", "wb") as out, open(f"{name}.heap", "wb") as heap:
            for batch in iterator:
                rows += batch.num_rows
                if self.mode == "table":
                    out.write(encode_rows(batch, self.columns, heap, seen))
                elif self.mode == "ascii":
                    out.write(encode_texts(batch, self.columns))
                elif self.mode == "groups":
                    out.write(self.group_rows(batch, seen))
                else:
                    pix = batch.column("pix").to_numpy().astype("<i8")
                    values = flat_bytes(batch.column("value"), self.column, seen)
                    both = np.zeros(len(pix), [("p", "<i8"), ("v", values.dtype)])
                    both["p"], both["v"] = pix, values
                    out.write(both.tobytes())
            size = heap.tell()
        part = Part(context.partitionId(), name, rows, size, dict(seen))
        if self.files and (rows or part.number == 0):
            with open(f"{name}.fits", "w+b") as f:
                self.publish(f, [part], 0)
        if self.files:
            os.remove(f"{name}.rows")
            os.remove(f"{name}.heap")
        return part

    def group_rows(self, batch: pa.RecordBatch, seen: Seen) -> bytes:
        """Random groups: parameters, then data, both by their scaling."""
        each, n, made = int(np.prod(self.axes)), batch.num_rows, []
        for name, count in (("params", None), ("data", each)):
            v = batch.column(name)
            sizes = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if n and (sizes != (sizes[0] if count is None else count)).any():
                raise errors.BadDimensions(f"{name} of {sorted(set(sizes.tolist()))} values in groups of {self.axes}")
            flat = v.flatten()
            if name == "data":
                made.append(flat_bytes(flat, self.column, seen).reshape(n, -1))
            else:
                grid = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, -1)
                own = [(*(x[i] if i < len(x) else d for x, d in zip(self.params, (1.0, 0.0), strict=True)),) for i in range(grid.shape[1])]
                columns = [flat_bytes(pa.array(grid[:, i]), scaled_column(f"parameter {i + 1}", self.bitpix, *own[i], None), Seen()) for i in range(grid.shape[1])]
                made.append(np.stack(columns, axis=1) if columns else np.zeros((n, 0), NUMPY[_CODES[self.bitpix]]))
        return np.concatenate(made, axis=1).astype(NUMPY[_CODES[self.bitpix]]).tobytes()

    def commit(self, messages):
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        tail = f"{self.path}.{uuid.uuid4().hex}.tmp"
        try:
            if self.mode == "update":
                self.update(tail, parts)
                return
            if self.files:
                self.folder(tail, parts)
                return
            with open(tail, "w+b") as f:
                if self.options.get("append", "false").lower() == "true":
                    with open(self.path, "rb") as old:
                        size = old.seek(0, 2)
                        *_, last = scan(old, size)
                        if last.end < size:
                            raise errors.BadExtension("special records follow the last HDU")
                        old.seek(0)
                        shutil.copyfileobj(old, f)
                    f.write(b"\0" * (-f.tell() % BLOCK))
                self.publish(f, parts, f.tell())
            if self.path.lower().endswith(".gz"):
                with open(tail, "rb") as plain, gzip.GzipFile(f"{tail}.gz", "wb", mtime=0) as packed:
                    shutil.copyfileobj(plain, packed)
                os.replace(f"{tail}.gz", tail)
            os.replace(tail, self.path)
        finally:
            if os.path.isfile(tail):
                os.remove(tail)
            shutil.rmtree(tail, ignore_errors=True)
            shutil.rmtree(self.parts, ignore_errors=True)

    def publish(self, f, parts: list[Part], begin: int) -> None:
        """The HDU of the parts at the end of a file, which is at begin."""
        if self.mode == "groups":
            if begin:
                raise errors.WrongHduType("random groups are the first HDU")
            self.groups(f, parts)
        elif self.mode in ("table", "ascii"):
            if begin == 0:
                f.write(block([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)]))
                begin = f.tell()
            (self.table if self.mode == "table" else self.texts)(f, parts)
        else:
            self.image(f, parts, begin == 0)
        if self.options.get("checksum", "false").lower() == "true":
            seal(f, begin, 1 if begin == 0 else 2)

    def folder(self, tail: str, parts: list[Part]) -> None:
        """A folder of the tasks' files takes the place of what was there; an empty table is one file."""
        os.makedirs(tail)
        own = [p for p in parts if p.rows] or parts[:1]
        for p in own:
            os.replace(f"{p.name}.fits", f"{tail}/part-{p.number:05d}.fits")
        target, old = self.path.rstrip("/"), f"{tail}.old"
        if os.path.lexists(target):
            os.replace(target, old)
        os.replace(tail, target)
        shutil.rmtree(old, ignore_errors=True) if os.path.isdir(old) else os.path.lexists(old) and os.remove(old)

    def abort(self, messages):
        shutil.rmtree(self.parts, ignore_errors=True)

    def extra(self):
        cards = [("EXTNAME", self.options["extname"])] if "extname" in self.options else []
        cards += [tuple(c) for c in json.loads(self.options.get("header", "[]"))]
        if self.options.get("checksum", "false").lower() == "true":
            cards += [("CHECKSUM", "0" * 16), ("DATASUM", "0")]
        return cards

    def table(self, f, parts: list[Part]) -> None:
        rows, heap = sum(p.rows for p in parts), sum(p.heap for p in parts)
        wide = heap > NARROW_HEAP
        inside, each = sum(o.width for o in self.columns), 16 if wide else 8
        width = sum(each if o.variable else o.width for o in self.columns)
        head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", rows), ("PCOUNT", heap), ("GCOUNT", 1), ("TFIELDS", len(self.columns))]
        for i, o in enumerate(self.columns, 1):
            head += [(f"TTYPE{i}", o.name), (f"TFORM{i}", o.form(wide))]
            head += [(f"TSCAL{i}", o.scale)] if o.scale != 1.0 else []
            head += [(f"TZERO{i}", o.zero)] if o.zero else []
            null = null_of(o, [p.seen for p in parts])
            head += [(f"TNULL{i}", null)] if null is not None else []
        f.write(block(head + self.extra()))
        moved = 0
        for p in parts:
            with open(f"{p.name}.rows", "rb") as src:
                while data := src.read(max(1, (1 << 22) // max(1, inside)) * max(1, inside)):
                    f.write(self.descriptors(data, inside, moved, each))
            moved += p.heap
        for p in parts:
            with open(f"{p.name}.heap", "rb") as src:
                shutil.copyfileobj(src, f)
        f.write(b"\0" * (-f.tell() % BLOCK))

    def descriptors(self, data: bytes, inside: int, moved: int, each: int) -> bytes:
        """Rows of a part file as they are published: descriptors moved to where the part's heap is, and of each bytes."""
        if not any(o.variable for o in self.columns):
            return data
        rows, made, at = np.frombuffer(data, np.uint8).reshape(-1, inside), [], 0
        for o in self.columns:
            own = np.ascontiguousarray(rows[:, at : at + o.width])
            if o.variable:
                pair = own.view(">i8").astype(np.int64)
                pair[:, 1] += np.where(pair[:, 0] > 0, moved, 0)
                if each == 8 and pair.max(initial=0) >= 1 << 31:
                    raise errors.BadHeap(o.name)
                own = pair.astype(f">i{each // 2}").view(np.uint8).reshape(len(rows), each)
            made.append(own)
            at += o.width
        return np.concatenate(made, axis=1).tobytes()

    def texts(self, f, parts: list[Part]) -> None:
        """An ASCII table: fields with a blank between them, filled up with blanks."""
        width, at, rows = sum(w for *_, w in self.columns) + len(self.columns) - 1, 1, sum(p.rows for p in parts)
        head = [("XTENSION", "TABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", rows), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(self.columns))]
        for i, (name, form, w) in enumerate(self.columns, 1):
            head += [(f"TTYPE{i}", name), (f"TBCOL{i}", at), (f"TFORM{i}", form)]
            at += w + 1
        f.write(block(head + self.extra()))
        for p in parts:
            with open(f"{p.name}.rows", "rb") as src:
                shutil.copyfileobj(src, f)
        f.write(b" " * (-f.tell() % BLOCK))

    def scaling(self, parts: list[Part]) -> list[tuple]:
        """The cards of the values' scaling and null."""
        o = self.column
        null = null_of(o, [p.seen for p in parts])
        cards = [("BSCALE", o.scale)] if o.scale != 1.0 else []
        cards += [("BZERO", float(o.zero))] if o.zero else []
        return cards + ([("BLANK", null)] if null is not None else [])

    def groups(self, f, parts: list[Part]) -> None:
        """Random groups, one after the other."""
        item = abs(self.bitpix) // 8
        rows, size, each = sum(p.rows for p in parts), sum(os.path.getsize(f"{p.name}.rows") for p in parts), int(np.prod(self.axes))
        count = size // item // rows - each if rows else 0
        if rows and any(os.path.getsize(f"{p.name}.rows") != item * p.rows * (count + each) for p in parts):
            raise errors.BadDimensions("groups of different sizes")
        head = [("SIMPLE", True), ("BITPIX", self.bitpix), ("NAXIS", len(self.axes) + 1), ("NAXIS1", 0), *[(f"NAXIS{i}", n) for i, n in enumerate(self.axes, 2)], ("EXTEND", True), ("GROUPS", True), ("PCOUNT", count), ("GCOUNT", rows)]
        for name, values, plain in zip(("PSCAL", "PZERO"), self.params, (1.0, 0.0), strict=True):
            head += [(f"{name}{i}", v) for i, v in enumerate(values[:count], 1) if v != plain]
        f.write(block(head + self.scaling(parts) + self.extra()))
        for p in parts:
            with open(f"{p.name}.rows", "rb") as src:
                shutil.copyfileobj(src, f)
        f.write(b"\0" * (-f.tell() % BLOCK))

    def image(self, f, parts: list[Part], primary: bool) -> None:
        head = [("SIMPLE", True)] if primary else [("XTENSION", "IMAGE")]
        head += [("BITPIX", self.bitpix), ("NAXIS", len(self.axes)), *[(f"NAXIS{i}", n) for i, n in enumerate(self.axes, 1)]]
        head += [("EXTEND", True)] if primary else [("PCOUNT", 0), ("GCOUNT", 1)]
        f.write(block(head + self.scaling(parts) + self.extra()))
        at, count = f.tell(), int(np.prod(self.axes, dtype=np.int64))
        f.truncate(at + -(-count * abs(self.bitpix) // 8 // BLOCK) * BLOCK)
        f.flush()
        self.put_pixels(f.name, at, count, self.bitpix, parts)
        f.seek(0, 2)

    @staticmethod
    def put_pixels(path: str, at: int, count: int, bitpix: int, parts: list[Part]) -> None:
        """The pixels of the part files, each at its place."""
        if not count:
            return
        kind = np.dtype(NUMPY[_CODES[bitpix]])
        pixels = np.memmap(path, kind, "r+", at, (count,))
        for p in parts:
            with open(f"{p.name}.rows", "rb") as src:
                pair = np.dtype([("p", "<i8"), ("v", kind)])
                while data := src.read((1 << 18) * pair.itemsize):
                    own = np.frombuffer(data, pair)
                    if len(own) and (own["p"].min() < 0 or own["p"].max() >= count):
                        raise errors.BadDimensions("a pixel beyond the axes")
                    pixels[own["p"]] = own["v"]
        pixels.flush()
        del pixels

    def update(self, tail: str, parts: list[Part]) -> None:
        """The file with some of an image's pixels changed; all others, and the rest of the file, stay as they are."""
        h = self.target
        if self.column.null is not None:
            null_of(self.column, [p.seen for p in parts])
        shutil.copy(self.path, tail)
        self.put_pixels(tail, h.data_at, int(np.prod(h.axes, dtype=np.int64)) if h.axes else 0, h.bitpix, parts)
        if h.header.has("CHECKSUM") and h.header.has("DATASUM"):
            with open(tail, "r+b") as f:
                seal(f, h.at, h.number)
        os.replace(tail, self.path)


def scaled_column(name: str, bitpix: int, scale: float, zero: float, null: int | None) -> Out:
    """A column of numbers that are stored as BITPIX says."""
    code = _CODES.get(bitpix)
    if code is None or scale == 0:
        raise errors.BadBitpix(f"{bitpix}, scale {scale}")
    if code in "ED":
        if (scale, zero) != (1.0, 0.0):
            raise errors.BadBitpix("real numbers are not scaled")
        return Out(name, code)
    return Out(name, code, zero=float(zero), scale=scale, null=least(code) if null is None else null)


def block(cards) -> bytes:
    """A header of whole blocks."""
    data = b"".join(card(*c) for c in cards) + b"END".ljust(80)
    return data + b" " * (-len(data) % BLOCK)


def seal(f, at: int, number: int) -> None:
    """Fill in DATASUM, then CHECKSUM, so that the HDU adds up to all ones."""
    f.flush()
    header, data_at = Header.read(f, at)
    hdu = make_hdu(number, header, at, data_at)
    total = integrity.sum_range(f, hdu.data_at, hdu.end)
    put(f, header, at, "DATASUM", str(total))
    put(f, header, at, "CHECKSUM", "0" * 16)
    whole = integrity.add(integrity.sum_range(f, hdu.at, hdu.data_at), total)
    put(f, header, at, "CHECKSUM", encode_number(ALL_ONES - whole))
    f.seek(0, 2)


def put(f, header: Header, at: int, name: str, value: str) -> None:
    """Overwrite one card in place."""
    i = next((k for k, c in enumerate(header.cards) if c.name == name), None)
    if i is None:
        raise errors.KeywordNotFound(name)
    f.seek(at + 80 * i)
    f.write(card(name, value))
    f.flush()


def write_compressed(
    pixels, path: str, shape: list[int], codec: str = "RICE_1", tile: list[int] | None = None, bitpix: int | None = None, dither: int | None = None, extname: str | None = None, checksum: bool = False,
    method: str = "SUBTRACTIVE_DITHER_1", blank: int | None = None,
) -> None:
    """pixels (pix, value) as a tile-compressed image: tiles are gathered, coded by tasks, and written as a table.

    Real numbers are quantized if dither, the seed, is given, or if the method is NO_DITHER.  blank
    stands for the nulls of integers; without it they are an error, as is a value that equals it.
    """
    kind = pixels.schema["value"].dataType.simpleString()
    bitpix = bitpix or {"smallint": 16, "int": 32, "bigint": 64, "float": -32, "double": -64, "tinyint": 8}[kind]
    quantize = bitpix < 0 and (dither is not None or method == "NO_DITHER")
    if dither is not None and not 1 <= dither <= 10000:
        raise errors.BadQuantization("ZDITHER0")
    if method not in ("NO_DITHER", "SUBTRACTIVE_DITHER_1", "SUBTRACTIVE_DITHER_2"):
        raise errors.BadQuantization(method)
    if codec in ("RICE_1", "PLIO_1", "HCOMPRESS_1") and (bitpix not in (8, 16, 32) or quantize):
        raise errors.UnsupportedCodec(f"{codec} of BITPIX {bitpix}")
    if codec == "HCOMPRESS_1" and len(shape) < 2:
        raise errors.UnsupportedCodec("HCOMPRESS_1 needs two axes")
    tile = tile or ([*shape[:2], *[1] * (len(shape) - 2)] if codec == "HCOMPRESS_1" else [shape[0], *[1] * (len(shape) - 1)])
    stored = {8: "u1", 16: "i2", 32: "i4", 64: "i8", -32: "f4", -64: "f8"}[bitpix]
    coords = arrays.unravel(F.col("pix"), shape)
    own_shape = F.array(*[F.least(F.lit(t), F.lit(n) - F.floor(c / t).cast("int") * t).cast("int") for c, t, n in zip(coords, tile, shape, strict=True)])
    rows = pixels.select(arrays.tile_of(coords, shape, tile).alias("tile"), "pix", "value", own_shape.alias("shape"))
    rows = rows.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("pix", "value"))).alias("p"), F.first("shape").alias("shape"))
    rows = rows.select("tile", F.transform("p", lambda x: x["value"]).alias("values"), "shape")
    keep_zero = method == "SUBTRACTIVE_DITHER_2"

    def whole(values):
        """Integers, with blank for null."""
        null = [x is None for x in values]
        if any(null) and blank is None:
            raise errors.BadValue("a null, and no blank")
        if any(null) and blank in values:
            raise errors.BadValue(f"{blank} stands for null and is a value too")
        return np.array([blank if x is None else x for x in values], stored)

    def batches(frames):
        for batch in frames:
            out = {"rownum": batch.column("tile"), "COMPRESSED_DATA": [], "GZIP_COMPRESSED_DATA": [], "ZSCALE": [], "ZZERO": []}
            for t, values, size in zip(batch.column("tile").to_pylist(), batch.column("values").to_pylist(), batch.column("shape").to_pylist(), strict=True):
                v, scale, zero, plain = np.array([np.nan if x is None else x for x in values], stored) if bitpix < 0 else whole(values), 1.0, 0.0, b""
                if quantize:
                    finite = v[np.isfinite(v)].astype("f8")
                    if not len(finite) or np.isinf(v).any():
                        plain, data = codecs.gzip_encode(v.astype(v.dtype.newbyteorder(">")).tobytes()), b""
                    else:
                        low, high = float(finite.min()), float(finite.max())
                        scale, zero = (1.0, low) if low == high else ((high - low) / 100000.0, (low + high) / 2)
                        q = codecs.quantize(v, scale, zero, None if method == "NO_DITHER" else codecs.dither(t + 1, len(v), dither), keep_zero)
                        data = codecs.encode(codec, q)
                else:
                    data = codecs.encode(codec, v, shape=(int(np.prod(size[1:])), size[0]) if codec == "HCOMPRESS_1" else None)
                for k, x in (("COMPRESSED_DATA", data), ("GZIP_COMPRESSED_DATA", plain), ("ZSCALE", scale), ("ZZERO", zero)):
                    out[k].append(x)
            arrays_ = [out["rownum"], pa.array(out["COMPRESSED_DATA"], pa.binary()), pa.array(out["GZIP_COMPRESSED_DATA"], pa.binary()), pa.array(out["ZSCALE"]), pa.array(out["ZZERO"])]
            yield pa.RecordBatch.from_arrays(arrays_, list(out))

    coded = rows.mapInArrow(batches, "rownum bigint, COMPRESSED_DATA binary, GZIP_COMPRESSED_DATA binary, ZSCALE double, ZZERO double").orderBy("rownum")
    coded = coded if quantize else coded.drop("GZIP_COMPRESSED_DATA", "ZSCALE", "ZZERO")
    head = [["ZIMAGE", True], ["ZCMPTYPE", codec], ["ZBITPIX", bitpix], ["ZNAXIS", len(shape)]]
    head += [[f"ZNAXIS{i}", n] for i, n in enumerate(shape, 1)] + [[f"ZTILE{i}", t] for i, t in enumerate(tile, 1)]
    head += [["ZNAME1", "BLOCKSIZE"], ["ZVAL1", 32], ["ZNAME2", "BYTEPIX"], ["ZVAL2", abs(bitpix) // 8]] if codec == "RICE_1" else []
    head += [["ZQUANTIZ", method], ["ZBLANK", codecs.NULL_CODE]] if quantize else []
    head += [["ZDITHER0", dither]] if quantize and method != "NO_DITHER" else []
    head += [["BLANK", blank]] if blank is not None and bitpix > 0 else []
    w = coded.write.format("fits").mode("overwrite").option("header", json.dumps(head)).option("checksum", str(checksum).lower())
    (w.option("extname", extname) if extname else w).save(path)
