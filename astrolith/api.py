"""Short ways to open, read, edit, check and write FITS files."""

from __future__ import annotations

import math
import os
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors
from .functions import arrays
from .operators import validate
from .session import prepare
from .sources import filespec, fits, fits_sink, integrity
from .sources.header import BLOCK, Card, Header, make_hdu, scan


def _read(path: str, mode: str, **options) -> DataFrame:
    spark = prepare(SparkSession.active())
    reader = spark.read.format("fits").option("mode", mode)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)


def info(path: str) -> DataFrame:
    """A row for each HDU, with the state of its checksums."""
    return _read(path, "hdus")


def cards(path: str) -> DataFrame:
    """A row for each card of each header."""
    return _read(path, "cards")


def table(path: str, **options) -> DataFrame:
    """The rows of a table."""
    return _read(path, "table", **options)


def image(path: str, **options) -> DataFrame:
    """The pixels of an image, or of a section of it."""
    return _read(path, "image", **options)


def getdata(path: str, hdu: int | None = None) -> DataFrame:
    """The data of an HDU, or of the first that has any, in the mode that fits it."""
    spec = filespec.parse(path)
    with fits.open_file(spec.path) as f:
        if hdu or spec.hdu or spec.extname:
            h = fits.select(f, hdu or spec.hdu, spec.extname, spec.extver)
        else:
            h = fits.select(f, wanted=lambda x: x.data_bytes > 0)
    mode = "image" if h.compressed or h.kind in ("primary", "image") else "groups" if h.kind == "random_groups" else "table"
    options = {"section": path[path.rindex("[") + 1 : -1]} if spec.section else {}
    return _read(spec.path, mode, hdu=h.number, **options)


def getheader(path: str, hdu: int | None = None) -> Header:
    """A header as an ordered set of cards."""
    spec = filespec.parse(path)
    with fits.open_file(spec.path) as f:
        return fits.select(f, hdu or spec.hdu or (None if spec.extname else 1), spec.extname, spec.extver).header


def getval(path: str, keyword: str, hdu: int | None = None, inherit: bool = False):
    """The value of a keyword; with inherit, the primary header's where the HDU has none and allows it."""
    header = getheader(path, hdu)
    if not header.has(keyword) and inherit and header.value("INHERIT") is True:
        from .functions.cards import STRUCTURAL

        if keyword not in STRUCTURAL and not re.match(r"^(NAXIS|T[A-Z]{4})\d+$", keyword):
            header = getheader(filespec.parse(path).path, 1)
    if not header.has(keyword):
        raise errors.KeywordNotFound(keyword)
    return header.value(keyword)


def wcs(path: str, hdu: int | None = None, alternative: str = ""):
    """The celestial coordinates that a header describes."""
    from .functions import sky

    h, a = getheader(path, hdu), alternative
    count = int(h.value(f"WCSAXES{a}") or h.value("NAXIS") or 2)
    types = [(h.text(f"CTYPE{i}{a}") or "").upper() for i in range(1, count + 1)]
    lon = next((i for i, t in enumerate(types) if re.match(r"^(RA--|.LON|..LN)", t)), None)
    lat = next((i for i, t in enumerate(types) if re.match(r"^(DEC-|.LAT|..LT)", t)), None)
    if lon is None or lat is None:
        raise errors.BadWcs("no celestial axes")
    first, second = sorted((lon, lat))
    at = (first + 1, second + 1)
    get = lambda k, d: h.real(f"{k}{a}", d)
    cd = any(h.has(f"CD{i}_{j}{a}") for i in at for j in at)
    pc = any(h.has(f"PC{i}_{j}{a}") for i in at for j in at)
    if cd and pc:
        raise errors.BadWcs("both CD and PC")
    cdelt = [get(f"CDELT{i}", 1.0) for i in at]
    m = sky.matrix(
        cdelt, [[get(f"PC{i}_{j}", float(i == j)) for j in at] for i in at] if pc else None, [[get(f"CD{i}_{j}", 0.0) for j in at] for i in at] if cd else None,
        h.real(f"CROTA{lat + 1}", 0.0) if h.has(f"CROTA{lat + 1}") else None,
    )
    pole = [h.real(f"{k}{a}") if h.has(f"{k}{a}") else None for k in ("LONPOLE", "LATPOLE")]
    swapped = lon > lat
    crval = (get(f"CRVAL{lon + 1}", 0.0), get(f"CRVAL{lat + 1}", 0.0))
    return sky.Celestial((get(f"CRPIX{at[0]}", 0.0), get(f"CRPIX{at[1]}", 0.0)), crval, m, types[lon][-3:], *pole, swapped)


def group_members(path: str, hdu: int | None = None) -> DataFrame:
    """A grouping table's rows with the HDU of each member, or null."""
    from .operators import grouping

    rows = table(path, **({"hdu": hdu} if hdu else {}))
    get = lambda name, kind: F.col(next(c for c in rows.columns if c.upper() == name)) if name in [c.upper() for c in rows.columns] else F.lit(None).cast(kind)
    rows = rows.select("rownum", get("MEMBER_LOCATION", "string").alias("location"), get("MEMBER_POSITION", "int").alias("position"), get("MEMBER_NAME", "string").alias("name"), get("MEMBER_VERSION", "int").alias("version"))
    return grouping.resolve(rows, info(filespec.parse(path).path).select("hdu", "extname", "extver"))


def verify(path: str) -> DataFrame:
    """All findings about a file: hdu, severity, kw, msg."""
    spark = prepare(SparkSession.active())
    plain = not path.lower().endswith(".gz")
    one = lambda *row: spark.createDataFrame([row], "hdu int, severity string, kw string, msg string")
    with fits.open_file(path) as f:
        size = fits.size_of(f)
        try:
            hdus = list(scan(f, size))
        except errors.MissingEnd:
            return one(1, "err", "END", "the header has no END")
        f.seek(hdus[-1].end)
        follows = f.read(8)
    found = validate.verify(info(path), cards(path))
    if size % BLOCK and plain:
        found = found.unionByName(one(0, "err", "", "the file is not a whole number of blocks"))
    if hdus[-1].end < size and plain:
        more = ("END", "the header has no END or no required keyword") if follows == b"XTENSION" else ("", "what follows is no HDU")
        found = found.unionByName(one(hdus[-1].number + 1, "err", *more))
    return found


def write_ascii(df: DataFrame, path: str, **options) -> None:
    """An ASCII table file, or with append=True one more ASCII table."""
    _write(df, path, "ascii", options)


def write_groups(df: DataFrame, path: str, axes: list[int], **options) -> None:
    """A file of random groups from (params, data), both arrays of doubles."""
    _write(df, path, "groups", options | {"axes": ",".join(map(str, axes))})


def write_table(df: DataFrame, path: str, **options) -> None:
    """A table file, or with append=True one more table."""
    _write(df, path, "table", options)


def write_image(df: DataFrame, path: str, axes: list[int], **options) -> None:
    """An image from (pix, value), or with append=True one more image."""
    _write(df, path, "image", options | {"axes": ",".join(map(str, axes))})


def _write(df: DataFrame, path: str, mode: str, options: dict) -> None:
    prepare(df.sparkSession)
    w = df.write.format("fits").mode("overwrite").option("mode", mode)
    for k, v in options.items():
        w = w.option(k, str(v).lower() if isinstance(v, bool) else str(v))
    w.save(path)


write_compressed = fits_sink.write_compressed


def write_pixels(df: DataFrame, path: str, hdu: int = 1) -> None:
    """Put pixels (pix, value) into an existing image, by its own scaling; all others stay."""
    prepare(df.sparkSession)
    df.write.format("fits").mode("overwrite").option("mode", "update").option("hdu", str(hdu)).save(path)


def write_section(df: DataFrame, path: str, section: str, hdu: int = 1) -> None:
    """Put pixels (pix, value), numbered inside a section, into an existing image; the gaps of its strides stay."""
    with fits.open_file(path) as f:
        shape = fits.select(f, hdu).axes
    low, high, step = filespec.resolve(filespec.parse(f"x[{section}]").section, shape)
    counts = arrays.section_counts(low, high, step)
    coords = [c * F.lit(s) + F.lit(a) for c, a, s in zip(arrays.unravel(F.col("pix"), counts), low, step, strict=True)]
    inside = F.col("pix").between(0, math.prod(counts) - 1)
    pix = F.when(inside, arrays.linear_index(coords, shape)).otherwise(F.raise_error(F.lit("BadDimensions: a pixel beyond the section")).cast("bigint"))
    write_pixels(df.select(pix.alias("pix"), "value"), path, hdu)


def for_each_image(path: str, function, group: int = 0, hdu: int | None = None, write_back: bool = False) -> DataFrame | None:
    """function(first pixel, values) over an image's pixels, group at a time; with write_back what it returns replaces them.

    Without write_back: a DataFrame (pix, value) of what it returns, nothing where that is None.
    """
    header = getheader(path, hdu)
    if header.value("ZIMAGE") is True:
        raise errors.BadDimensions("a compressed image")
    if header.integer("NAXIS") == 0:
        return None
    number = hdu or filespec.parse(path).hdu or 1
    pixels = image(filespec.parse(path).path, hdu=number).select("pix", "value")

    def batches(frames):
        import pyarrow as pa

        for batch in frames:
            for a in range(0, batch.num_rows, group or max(1, batch.num_rows)):
                part = batch.slice(a, group) if group else batch
                out = function(part.column(0)[0].as_py(), part.column(1))
                if out is not None:
                    out = out if isinstance(out, pa.Array) else pa.array(out)
                    yield pa.RecordBatch.from_arrays([part.column(0), out.cast(part.column(1).type)], ["pix", "value"])

    made = pixels.mapInArrow(batches, pixels.schema)
    if not write_back:
        return made
    write_pixels(made, filespec.parse(path).path, number)
    return None


def _rewrite(path: str, change) -> None:
    """Apply change(HDU, header bytes) to each HDU and publish the result by one rename.

    It gives None to leave the HDU out, a header, or a header and the size that the data unit is cut
    or filled up with zeros to.  An HDU with a new header is sealed again if it was sealed.
    """
    tail, again = f"{path}.{uuid.uuid4().hex}.tmp", []
    try:
        with open(path, "rb") as f, open(tail, "wb") as out:
            size = fits.size_of(f)
            for h in scan(f, size):
                f.seek(h.at)
                head = f.read(h.data_at - h.at)
                got = change(h, head)
                if got is None:
                    continue
                new, bytes_ = got if isinstance(got, tuple) else (got, None)
                if new != head:
                    again.append((out.tell(), h.number))
                out.write(new)
                left = h.end - h.data_at if bytes_ is None else min(h.data_bytes, bytes_)
                _copy(f, out, h.data_at, left)
                if bytes_ is not None:
                    out.truncate(out.tell() + -(-bytes_ // BLOCK) * BLOCK - left)
                    out.seek(0, 2)
        with open(tail, "r+b") as out:
            for at, number in again:
                header = Header.read(out, at)[0]
                if header.has("CHECKSUM") and header.has("DATASUM"):
                    fits_sink.seal(out, at, number)
        os.replace(tail, path)
    finally:
        if os.path.exists(tail):
            os.remove(tail)


def _copy(f, out, at: int, left: int) -> None:
    """So many bytes from a place of one file to another, in pieces."""
    f.seek(at)
    while left > 0:
        data = f.read(min(left, integrity.PIECE))
        if not data:
            break
        out.write(data)
        left -= len(data)


def delete_hdu(path: str, hdu: int) -> None:
    """Leave out an extension."""
    if hdu == 1:
        raise errors.WrongHduType("the primary HDU stays")
    _rewrite(path, lambda h, head: None if h.number == hdu else head)


def copy_hdu(path: str, hdu: int) -> None:
    """Append an extension's bytes once more."""
    if hdu == 1:
        raise errors.WrongHduType("the primary HDU cannot be an extension")
    tail = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with open(path, "rb") as f:
            h = fits.select(f, hdu)
            shutil.copy(path, tail)
            with open(tail, "r+b") as out:
                out.seek(0, 2)
                _copy(f, out, h.at, h.end - h.at)
        os.replace(tail, path)
    finally:
        if os.path.exists(tail):
            os.remove(tail)


def edit_header(path: str, hdu: int, update: dict | None = None, delete: list[str] | None = None, rename: dict | None = None, insert: list[tuple] | None = None, reserve: int = 0) -> None:
    """Change cards of a header: update replaces or adds, and keeps a comment that is not given.

    Values of update may be (value, comment).  insert has (place among the cards, from 0, keyword,
    value) or a comment after these; reserve adds blank cards, which new keywords fill first.
    CONTINUE cards go with the card that they go on with.  Mandatory cards keep their places, and
    checksums are brought up to date.
    """
    update, delete, rename = dict(update or {}), set(delete or []), dict(rename or {})

    def change(h, head):
        if h.number != hdu:
            return head
        mandatory = {"SIMPLE", "XTENSION", "BITPIX", "NAXIS", *(f"NAXIS{i}" for i in range(1, len(h.axes) + 1))}
        if (touched := mandatory & (delete | set(rename))) or mandatory & {x[1] for x in insert or []}:
            raise errors.BadKeyword(f"{sorted(touched) or 'mandatory keywords'} cannot be moved")
        lines, gone = [], False
        for c in h.header.cards:
            if c.kind == "continue":
                if not gone:
                    lines.append(c.raw.encode("latin-1"))
                continue
            gone = c.name in delete
            if gone:
                continue
            raw = c.raw.encode("latin-1")
            if c.name in rename:
                raw = rename[c.name].ljust(8).encode() + raw[8:]
            if c.name in update:
                new, gone = update.pop(c.name), True
                new = new if isinstance(new, tuple) else (new, c.comment)
                raw = fits_sink.card(rename.get(c.name, c.name), *new)
            lines.append(raw)
        first = 3 + len(h.axes)
        for place, *one in sorted(insert or [], key=lambda x: -x[0]):
            if place < first:
                raise errors.BadKeyword(f"place {place} is a mandatory keyword's")
            lines.insert(min(place, len(lines)), fits_sink.card(*one))
        for k, v in update.items():
            new = fits_sink.card(k, *(v if isinstance(v, tuple) else (v,)))
            blank = next((i for i, x in enumerate(lines) if x == b" " * 80), None)
            if blank is None:
                lines.append(new)
            else:
                lines[blank] = new
        data = b"".join(lines) + b" " * (80 * reserve) + b"END".ljust(80)
        return data + b" " * (-len(data) % BLOCK)

    _rewrite(path, change)


def put_header(path: str, header: Header, hdu: int = 1) -> None:
    """Put a changed header in place of an HDU's own; it must describe the same data unit."""

    def change(h, head):
        if h.number != hdu:
            return head
        new = make_hdu(h.number, header, h.at, h.data_at)
        if new.data_bytes != h.data_bytes:
            raise errors.BadDimensions("the header describes another data unit")
        return header.to_bytes()

    _rewrite(path, change)


def reshape_image(path: str, hdu: int, bitpix: int, axes: list[int]) -> None:
    """Give an image another type or other axes: its bytes are kept as they are, cut off or filled up with zeros."""

    def change(h, head):
        if h.number != hdu:
            return head
        if h.kind not in ("primary", "image"):
            raise errors.WrongHduType(h.kind)
        if bitpix not in (8, 16, 32, 64, -32, -64):
            raise errors.BadBitpix(str(bitpix))
        if any(n < 0 for n in axes) or len(axes) > 999:
            raise errors.BadNaxis(str(axes))
        own = {"BITPIX", "NAXIS", *(f"NAXIS{i}" for i in range(1, len(h.axes) + 1))}
        first, *rest = h.header.cards
        new = [fits_sink.card("BITPIX", bitpix), fits_sink.card("NAXIS", len(axes)), *(fits_sink.card(f"NAXIS{i}", n) for i, n in enumerate(axes, 1))]
        data = first.raw.encode("latin-1") + b"".join(new) + b"".join(c.raw.encode("latin-1") for c in rest if c.name not in own) + b"END".ljust(80)
        return data + b" " * (-len(data) % BLOCK), abs(bitpix) // 8 * math.prod(axes) if axes else 0

    _rewrite(path, change)


def update_checksums(path: str, hdu: int | None = None) -> None:
    """Bring DATASUM and CHECKSUM of an HDU, or of all, up to date; cards that are missing are added."""
    cards_ = [("CHECKSUM", "0" * 16), ("DATASUM", "0")]

    def change(h, head):
        if hdu not in (None, h.number):
            return head
        missing = b"".join(fits_sink.card(*c) for c in cards_ if not h.header.has(c[0]))
        lines = b"".join(c.raw.encode("latin-1") for c in h.header.cards)
        data = lines + missing + b"END".ljust(80)
        return data + b" " * (-len(data) % BLOCK)

    _rewrite(path, change)
    with open(path, "rb") as f:
        places = [(h.at, h.number) for h in scan(f, fits.size_of(f)) if hdu in (None, h.number)]
    tail = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        shutil.copy(path, tail)
        with open(tail, "r+b") as out:
            for at, number in places:
                fits_sink.seal(out, at, number)
        os.replace(tail, path)
    finally:
        if os.path.exists(tail):
            os.remove(tail)


class Hdus:
    """A place among a file's HDUs: by number from 1, by a step, or the current one."""

    def __init__(self, path: str):
        with fits.open_file(path) as f:
            self.hdus = list(scan(f, fits.size_of(f)))
        self.number = 1

    def __len__(self) -> int:
        return len(self.hdus)

    @property
    def current(self):
        return self.hdus[self.number - 1]

    def select(self, number: int):
        if not 1 <= number <= len(self.hdus):
            raise errors.WrongHduType(f"no HDU {number}")
        self.number = number
        return self.current

    def move(self, by: int):
        return self.select(self.number + by)


def save_gzip(path: str, out: str) -> None:
    """The file as a whole-file gzip."""
    import gzip

    with open(path, "rb") as f, gzip.GzipFile(out, "wb", mtime=0) as g:
        shutil.copyfileobj(f, g)


def build_template(text: str) -> bytes:
    """Headers from a template: comment lines begin with # or //, SIMPLE and XTENSION begin an HDU.

    ``KEY#`` counts up within its HDU, the equals sign may be missing, texts need no quotes, and lines
    that begin with a backslash are refused.
    """
    hdus: list[list[tuple]] = []
    counters: dict[str, int] = {}
    for line in text.splitlines():
        t = line.strip()
        if not t or t.startswith(("#", "//")):
            continue
        if t.startswith("\\"):
            raise errors.BadExtension(t)
        m = re.match(r"^([A-Za-z0-9_-]+#?)\s*=?\s*(.*)$", t)
        if not m:
            raise errors.BadCard(t)
        name, rest = m[1].upper(), m[2].strip()
        if name in ("SIMPLE", "XTENSION") or not hdus:
            hdus.append([])
            counters = {}
        if name.endswith("#"):
            counters[name] = counters.get(name, 0) + 1
            name = f"{name[:-1]}{counters[name]}"
        if name in ("COMMENT", "HISTORY"):
            hdus[-1].append((name, rest))
            continue
        value, _, comment = (rest, "", "") if rest.startswith("'") else (x.strip() for x in rest.partition("/"))
        if value.startswith("'"):
            parsed = Card.parse(f"{name:<8}= {value}"[:80].ljust(80))
            value, comment = parsed.value, parsed.comment or ""
        else:
            try:
                from .sources.header import parse_value

                value = parse_value(value)[0]
            except errors.BadValue:
                pass  # a text without quotes
        hdus[-1].append((name, value, comment or None))
    return b"".join(fits_sink.block([c for c in cards_ if c[0] != "END"]) for cards_ in hdus)
