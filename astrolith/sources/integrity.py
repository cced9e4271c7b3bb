"""DATASUM and CHECKSUM of a file's HDUs, read in pieces."""

from __future__ import annotations

import numpy as np

from ..functions.checksum import ALL_ONES

PIECE = 2880 * 1024


def add(a: int, b: int) -> int:
    """One's-complement addition of 32 bits."""
    total = a + b
    return (total & ALL_ONES) + (total >> 32)


def sum_bytes(data) -> int:
    """The sum of whole 32-bit words, most significant byte first."""
    total = int(np.frombuffer(data, ">u4").sum(dtype=np.uint64))
    while total >> 32:
        total = (total & ALL_ONES) + (total >> 32)
    return total


def sum_range(f, first: int, last: int) -> int:
    """The sum of a file's bytes from first up to last."""
    total = 0
    f.seek(first)
    while first < last:
        data = f.read(min(PIECE, last - first))
        if not data:
            break
        first += len(data)
        total = add(total, sum_bytes(data + b"\0" * (-len(data) % 4)))
    return total


def verify(f, hdu) -> tuple[str, str]:
    """match, mismatch, not_present or unreadable, for DATASUM and for CHECKSUM."""
    data = sum_range(f, hdu.data_at, hdu.end)
    want, code = hdu.header.value("DATASUM"), hdu.header.value("CHECKSUM")
    known = isinstance(want, str) and want.strip().isdigit() and int(want) <= ALL_ONES
    one = "not_present" if want is None or want == "" else "unreadable" if not known else "match" if int(want) == data else "mismatch"
    if code is None or code == "" or isinstance(code, str) and set(code) <= {"0", " "}:
        return one, "not_present"
    if not isinstance(code, str) or len(code.rstrip()) != 16:
        return one, "unreadable"
    whole = add(sum_range(f, hdu.at, hdu.data_at), data)
    return one, "match" if whole in (0, ALL_ONES) else "mismatch"
