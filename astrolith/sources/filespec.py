"""Extended file names: path, then HDU by number or by name and version, then an image section."""

from __future__ import annotations

import dataclasses
import re

from .. import errors


@dataclasses.dataclass
class FileSpec:
    """hdu counts from 1; a section has (lower, upper, stride) for each axis, from 0, None for an open end."""

    path: str
    hdu: int | None = None
    extname: str | None = None
    extver: int | None = None
    section: list[tuple[int, int | None, int]] | None = None


#: What a row, column or binning filter looks like; these are refused.
_FILTER = re.compile(r"(?i)^(col|bin|pix|hist)\b|[<>=!&|]|gtifilter|regfilter|#row")


def parse(name: str) -> FileSpec:
    """The parts of an extended file name."""
    path, bracket, rest = name.partition("[")
    if not path:
        raise errors.EmptyPath(name)
    spec, rest = FileSpec(path), bracket + rest
    while rest:
        if rest[0] != "[":
            raise errors.TrailingChars(rest)
        group, closed, rest = rest[1:].partition("]")
        if not closed:
            raise errors.UnbalancedBracket(name)
        _group(spec, group.strip(" "))
    return spec


def _group(spec: FileSpec, text: str) -> None:
    if not text:
        raise errors.EmptyBracket(spec.path)
    if _FILTER.search(text):
        raise errors.UnsupportedFilter(text)
    parts = [p.strip(" ") for p in text.split(",")]
    ranged = [bool(re.fullmatch(r"\d+", p)) or p == "*" or ":" in p for p in parts]
    if len(parts) == 1 and not (parts[0] == "*" or ":" in parts[0]):
        if spec.hdu is not None or spec.extname is not None:
            raise errors.DuplicateSelector(text)
        if re.fullmatch(r"[+-]?\d+", text):
            if int(text) < 0:
                raise errors.BadHduIndex(text)
            spec.hdu = int(text) + 1
        else:
            spec.extname = text
    elif all(ranged):
        if spec.section is not None:
            raise errors.DuplicateSelector(text)
        spec.section = [_range(p) for p in parts]
    elif len(parts) != 2:
        raise errors.BadExtVer(text)
    elif not parts[0] or ranged[0]:
        raise errors.BadSection(text)
    elif not re.fullmatch(r"[+-]?\d+", parts[1]):
        raise errors.BadExtVer(text)
    elif spec.hdu is not None or spec.extname is not None:
        raise errors.DuplicateSelector(text)
    else:
        spec.extname, spec.extver = parts[0], int(parts[1])


def _range(text: str) -> tuple[int, int | None, int]:
    def number(t: str) -> int:
        if not re.fullmatch(r"\d+", t) or int(t) == 0:
            raise errors.BadSection(text)
        return int(t)

    parts = [p.strip(" ") for p in text.split(":")]
    if len(parts) > 3 or not text:
        raise errors.BadSection(text)
    if len(parts) == 1:
        return (0, None, 1) if text == "*" else (number(text) - 1, number(text) - 1, 1)
    low = 0 if parts[0] == "*" else number(parts[0]) - 1
    high = None if parts[1] == "*" else number(parts[1]) - 1
    return low, high, number(parts[2]) if len(parts) == 3 else 1


def resolve(section, shape: list[int]) -> tuple[list[int], list[int], list[int]]:
    """lower, upper and stride of a section against an image's axes."""
    if len(section) != len(shape):
        raise errors.BadDimensions(f"{len(section)} ranges for {len(shape)} axes")
    lower, upper, stride = (list(x) for x in zip(*((a, n - 1 if b is None else b, s) for (a, b, s), n in zip(section, shape, strict=True)), strict=True))
    if any(a > b or b >= n for a, b, n in zip(lower, upper, shape, strict=True)):
        raise errors.BadDimensions(f"section beyond {shape}")
    return lower, upper, stride
