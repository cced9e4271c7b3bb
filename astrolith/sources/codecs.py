"""Codecs of tiles: GZIP_1, GZIP_2, RICE_1, PLIO_1, HCOMPRESS_1, and subtractive dithering.

They work on one tile at a time, with numpy where the format lets whole arrays be handled at once.
"""

from __future__ import annotations

import gzip
import zlib

import numpy as np

from ..errors import CorruptData, LimitExceeded, UnsupportedCodec
from . import hcompress

#: Fixed values of the format: bits of a RICE block's code, the code for verbatim values less one, bits of a value.
RICE = {1: (3, 6, 8), 2: (4, 14, 16), 4: (5, 25, 32)}
#: Fixed values of the format: stored integers that stand for NaN and, with the second method, for zero.
NULL_CODE, ZERO_CODE = -2147483647, -2147483646
RESERVED = 10
#: Fixed values of the format: the random sequence's length, multiplier and modulus.
RANDOM_COUNT, RANDOM_A, RANDOM_M = 10_000, 16807, 2147483647
MAX_TILE = 1 << 30


def gzip_encode(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def gzip_decode(data: bytes, size: int) -> bytes:
    """The size bytes that a gzip member holds; anything else is an error, and no more is inflated."""
    if size > MAX_TILE:
        raise LimitExceeded("tile")
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(data, size + 1)
    except zlib.error as e:
        raise CorruptData(str(e)) from None
    if len(out) != size:
        raise CorruptData(f"{len(out)} bytes instead of {size}")
    return out


def shuffle(data: bytes, width: int) -> bytes:
    """Bytes by significance: all first bytes of the values, then all second ones, ..."""
    return np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes()


def unshuffle(data: bytes, width: int) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.tobytes()


def rice_encode(values: np.ndarray, width: int, block: int = 32) -> bytes:
    """Differences of neighbours, mapped to 0, -1, 1, -2, ..., in blocks with a common number of low bits.

    Where each code begins follows from running sums of lengths, so all bits are set at once.
    """
    if width not in RICE:
        raise UnsupportedCodec(f"RICE_1 of {width} bytes")
    fsbits, fsmax, bbits = RICE[width]
    half, mask = 1 << (bbits - 1), (1 << bbits) - 1
    x = np.asarray(values).ravel().astype(np.int64) & mask
    n = len(x)
    if not n:
        return b""
    diff = ((np.diff(x, prepend=x[0]) + half) & mask) - half
    mapped = np.where(diff < 0, -2 * diff - 1, 2 * diff)
    blocks = -(-n // block)
    of = np.arange(n) // block
    sizes, totals = np.bincount(of, minlength=blocks), np.add.reduceat(mapped, np.arange(0, n, block))
    mean = np.maximum(0, totals - sizes // 2 - 1) // sizes
    fs = np.frexp((mean >> 1).astype(np.float64))[1].astype(np.int64)
    empty, plain = totals == 0, (fs >= fsmax) & (totals > 0)
    code = np.where(empty, 0, np.where(plain, fsmax + 1, fs + 1))
    high = np.where(plain | empty, 0, fs)[of]
    top = np.where((plain | empty)[of], 0, mapped >> high)
    length = np.where(empty[of], 0, np.where(plain[of], bbits, top + 1 + high))
    # A block's code stands before its values.
    ends = np.cumsum(length)
    begin = bbits + ends - length + (of + 1) * fsbits
    at_code = bbits + np.arange(blocks) * fsbits + np.concatenate([[0], ends[np.arange(block, n, block) - 1]])
    bits = np.zeros(int(bbits + ends[-1] + blocks * fsbits), np.uint8)

    def put(places, numbers, count):
        for k in range(count):
            bits[places + k] = (numbers >> (count - 1 - k)) & 1

    put(np.zeros(1, np.int64), x[:1], bbits)
    put(at_code, code, fsbits)
    verbatim = plain[of]
    put(begin[verbatim], mapped[verbatim], bbits)
    coded = ~(verbatim | empty[of])
    bits[(begin + top)[coded]] = 1
    for f in np.unique(fs[~(plain | empty)]).tolist():
        own = coded & (high == f)
        put((begin + top + 1)[own], mapped[own], f)
    return np.packbits(bits).tobytes()


def rice_decode(data: bytes, count: int, width: int, block: int = 32) -> np.ndarray:
    """count signed values.

    Only the walk from code to code is a loop: where the next 1 stands is looked up, and low bits,
    differences and sums are taken for all values at once.
    """
    if width not in RICE:
        raise UnsupportedCodec(f"RICE_1 of {width} bytes")
    fsbits, fsmax, bbits = RICE[width]
    mask, half = (1 << bbits) - 1, 1 << (bbits - 1)
    kind = {1: np.int8, 2: np.int16, 4: np.int32}[width]
    if not count:
        return np.zeros(0, kind)
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    size = len(bits)
    ones = np.flatnonzero(bits)
    following = np.full(size + 1, size, np.int64)
    following[ones] = ones
    following = np.minimum.accumulate(following[::-1])[::-1].tolist()

    def numbers(places, n):
        out = np.zeros(len(places), np.int64)
        for k in range(n):
            out = (out << 1) | bits[places + k]
        return out

    if size < bbits:
        raise CorruptData("the bits end early")
    at, first = bbits, int(numbers(np.zeros(1, np.int64), bbits)[0])
    mapped, low_at, low_bits = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for a in range(0, count, block):
        n = min(block, count - a)
        if at + fsbits > size:
            raise CorruptData("the bits end early")
        fs = int(numbers(np.array([at]), fsbits)[0]) - 1
        at += fsbits
        if fs < 0:
            continue
        if fs > fsmax:
            raise CorruptData("a block's code is out of range")
        if fs == fsmax:
            low_at[a : a + n], low_bits[a : a + n] = at + bbits * np.arange(n), bbits
            at += bbits * n
        else:
            tops, places = [], []
            for _ in range(n):
                one = following[at] if at < size else size
                if one >= size:
                    raise CorruptData("the bits end early")
                tops.append(one - at)
                places.append(one + 1)
                at = one + 1 + fs
            mapped[a : a + n] = np.array(tops, np.int64) << fs
            low_at[a : a + n], low_bits[a : a + n] = places, fs
        if at > size:
            raise CorruptData("the bits end early")
    for f in np.unique(low_bits).tolist():
        own = low_bits == f
        mapped[own] |= numbers(low_at[own], f)
    diff = np.where(mapped & 1, -((mapped + 1) >> 1), mapped >> 1)
    return (((first + np.cumsum(diff)) + half & mask) - half).astype(kind)


def plio_encode(values: np.ndarray) -> np.ndarray:
    """A mask of 0 to 2^24 - 1 as 16-bit words: runs of zeros and of a current high value."""
    words: list[int] = []
    high, at, x = 1, 0, values.tolist()
    if any(not 0 <= v < 1 << 24 for v in x):
        raise UnsupportedCodec("PLIO_1 of negative or large values")
    put = lambda op, n: words.append((op << 12) | n)
    while at < len(x):
        v, end = x[at], at
        while end < len(x) and x[end] == v:
            end += 1
        n = end - at
        if v == 0:
            while n > 0:
                put(0, min(n, 4095))
                n -= 4095
        else:
            step = v - high
            if step and abs(step) <= 4095:
                put(2 if step > 0 else 3, abs(step))
            elif step:
                put(1, v & 4095)
                words.append(v >> 12)
            high = v
            while n > 0:
                put(4, min(n, 4095))
                n -= 4095
        at = end
    size = 7 + len(words)
    return np.array([0, 7, -100, size & 32767, size >> 15, 0, 0, *words], np.int64).astype(">i2")


def plio_decode(words: np.ndarray, count: int) -> np.ndarray:
    """count values of a mask."""
    w = [int(v) & 0xFFFF for v in np.asarray(words).tolist()]
    if len(w) < 7:
        raise CorruptData("a mask of fewer than seven words")
    if w[2] >> 15:  # the longer header
        size, at = (w[4] << 15) | w[3], w[1]
    else:
        size, at = w[2], 3
    out, pos, high = np.zeros(count, np.int64), 0, 1
    while at < min(size, len(w)) and pos < count:
        op, n = w[at] >> 12, w[at] & 4095
        at += 1
        if op == 0:
            pos += n
        elif op == 1:
            high = (w[at] << 12) | n
            at += 1
        elif op in (2, 3):
            high += n if op == 2 else -n
        elif op == 4:
            out[pos : min(pos + n, count)] = high
            pos += n
        elif op == 5:
            pos += n
            if 0 < pos <= count:
                out[pos - 1] = high
        else:
            high += n if op == 6 else -n
            if pos < count:
                out[pos] = high
            pos += 1
    return out


_SEEDS: np.ndarray | None = None


def random_seeds() -> np.ndarray:
    """The seeds of the format's 10,000 random numbers: a Park-Miller generator from seed 1."""
    global _SEEDS
    if _SEEDS is None:
        out, seed = np.empty(RANDOM_COUNT, np.int64), 1
        for i in range(RANDOM_COUNT):
            seed = seed * RANDOM_A % RANDOM_M
            out[i] = seed
        _SEEDS = out
    return _SEEDS


def random_sequence() -> np.ndarray:
    """The format's 10,000 numbers in [0, 1)."""
    return (random_seeds() / RANDOM_M).astype(np.float32)


def dither(tile: int, count: int, zdither: int = 1) -> np.ndarray:
    """The numbers that a tile, counted from 1, draws: one for each of its pixels."""
    r = random_sequence()
    row = (tile + zdither - 2) % RANDOM_COUNT
    out, got = np.empty(count, np.float32), 0
    at = int(r[row] * 500)
    while got < count:
        n = min(count - got, RANDOM_COUNT - at)
        out[got : got + n] = r[at : at + n]
        got += n
        row = (row + 1) % RANDOM_COUNT
        at = int(r[row] * 500)
    return out


def quantize(values: np.ndarray, scale: float, zero: float, draws: np.ndarray | None = None, keep_zero: bool = False) -> np.ndarray:
    """Stored integers of real values; NaN and, if asked for, zero have codes of their own."""
    v = np.asarray(values, np.float64)
    r = 0.5 if draws is None else draws.astype(np.float64)
    with np.errstate(invalid="ignore"):
        x = (v - zero) / scale + r - 0.5
        q = np.where(np.isnan(v), NULL_CODE, np.sign(x) * np.floor(np.abs(x) + 0.5))
    if keep_zero:
        q = np.where(v == 0, ZERO_CODE, q)
    low = -(1 << 31) + RESERVED
    if np.any((np.abs(q) > (1 << 31) - 1) | ((q < low) & (q != NULL_CODE) & (q != ZERO_CODE))):
        raise UnsupportedCodec("quantized values do not fit")
    return q.astype(np.int32)


def unquantize(stored: np.ndarray, scale: float, zero: float, draws: np.ndarray | None = None, keep_zero: bool = False, null: int = NULL_CODE) -> np.ndarray:
    """Real values of stored integers."""
    q = np.asarray(stored, np.float64)
    r = 0.5 if draws is None else draws.astype(np.float64)
    out = (q - r + 0.5) * scale + zero
    out[q == null] = np.nan
    if keep_zero:
        out[q == ZERO_CODE] = 0.0
    return out


def encode(codec: str, values: np.ndarray, block: int = 32, shape: tuple[int, ...] | None = None) -> bytes:
    """A tile's bytes; values have their stored type."""
    v = np.asarray(values)
    big = v.astype(v.dtype.newbyteorder(">"))
    if codec == "GZIP_1":
        return gzip_encode(big.tobytes())
    if codec == "GZIP_2":
        return gzip_encode(shuffle(big.tobytes(), v.dtype.itemsize))
    if codec == "RICE_1":
        return rice_encode(v.ravel(), v.dtype.itemsize, block)
    if codec == "PLIO_1":
        return plio_encode(v.ravel()).tobytes()
    if codec == "HCOMPRESS_1":
        return hcompress.encode(v.reshape(shape if shape else v.shape))
    raise UnsupportedCodec(codec)


def decode(codec: str, data: bytes, count: int, kind: np.dtype, block: int = 32) -> np.ndarray:
    """count values of a stored type from a tile's bytes."""
    kind = np.dtype(kind)
    if count * kind.itemsize > MAX_TILE:
        raise LimitExceeded("tile")
    if codec in ("GZIP_1", "GZIP_2"):
        raw = gzip_decode(data, count * kind.itemsize)
        raw = unshuffle(raw, kind.itemsize) if codec == "GZIP_2" else raw
        return np.frombuffer(raw, kind.newbyteorder(">")).astype(kind)
    if codec in ("RICE_1", "RICE_ONE"):
        # Bytes are stored unsigned but coded as signed ones that wrap around.
        return rice_decode(data, count, kind.itemsize, block).astype(kind)
    if codec == "PLIO_1":
        return plio_decode(np.frombuffer(data, ">i2"), count).astype(kind)
    if codec == "HCOMPRESS_1":
        return hcompress.decode(data).ravel()[:count].astype(kind)
    raise UnsupportedCodec(codec)
