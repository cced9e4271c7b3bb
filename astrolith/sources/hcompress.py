"""HCOMPRESS_1: the integer H-transform, coded by quadtrees of its bit planes."""

from __future__ import annotations

import struct

import numpy as np

from ..errors import CorruptData, LimitExceeded, UnsupportedCodec

MAGIC = b"\xdd\x99"
#: Fixed values of the format: the code of each of a quadtree node's sixteen values.
CODES = {
    0: "111110", 1: "000", 2: "001", 3: "1000", 4: "010", 5: "1001", 6: "11010", 7: "11011",
    8: "011", 9: "11100", 10: "1010", 11: "11101", 12: "1011", 13: "11110", 14: "111111", 15: "1100",
}
_VALUES = {c: v for v, c in CODES.items()}
_HEAD = ">iiiqBBB"


def _levels(n: int) -> int:
    """How often n is halved, rounded up, until it is 1."""
    return max(0, n - 1).bit_length()


def _near(x, step: int):
    """The nearest multiple of step; from the middle, away from zero for positive x and towards minus infinity's side for others."""
    return np.where(x >= 0, x + step // 2, x + max(step // 2 - 1, 0)) & np.int64(-step)


def _out(x, step: int):
    """x, if it is no multiple of step = 2 * s, moved by s away from zero; x is a multiple of s or s is 1."""
    return np.where(x >= 0, x + step // 2, x) & np.int64(-step)


def forward(image: np.ndarray) -> np.ndarray:
    """Level by level the sums of 2 by 2 pixels stand first in each axis, the differences after them.

    Differences are rounded to even multiples of the level's step and sums to multiples of four
    steps: the bits that go follow from those of the mixed difference, which keeps all of its own.
    """
    a = image.astype(np.int64).copy()
    nx, ny = a.shape
    step = 1
    for level in range(_levels(max(a.shape))):
        down = 0 if level == 0 else 1
        px, py, sx, sy = nx // 2, ny // 2, (nx + 1) // 2, (ny + 1) // 2
        b, out = a[:nx, :ny], np.empty((nx, ny), np.int64)
        p, q = b[0 : 2 * px : 2], b[1 : 2 * px : 2]
        across = q + p, q - p  # sums and differences of rows
        for k, rows in enumerate(across):
            low, high = rows[:, 0 : 2 * py : 2], rows[:, 1 : 2 * py : 2]
            total, change = (high + low) >> down, (high - low) >> down
            if k == 0:
                out[:px, :py], out[:px, sy:] = _near(total, 4 * step), _out(change, 2 * step)
            else:
                out[sx:, :py], out[sx:, sy:] = _out(total, 2 * step), change
        if ny % 2:
            out[:px, py], out[sx:, py] = _near(across[0][:, -1] << (1 - down), 4 * step), _out(across[1][:, -1] << (1 - down), 2 * step)
        if nx % 2:
            low, high = b[-1, 0 : 2 * py : 2], b[-1, 1 : 2 * py : 2]
            out[px, :py], out[px, sy:] = _near((high + low) << (1 - down), 4 * step), _out((high - low) << (1 - down), 2 * step)
        if nx % 2 and ny % 2:
            out[px, py] = _near(b[-1, -1] << (2 - down), 4 * step)
        a[:nx, :ny] = out
        nx, ny, step = sx, sy, 2 * step
    return a


def _toward(x, y):
    """x moved by y towards zero."""
    return np.where(x >= 0, x - y, x + y)


def inverse(coefficients: np.ndarray) -> np.ndarray:
    """The image of a transform, exactly if nothing was lost."""
    a = coefficients.astype(np.int64).copy()
    count = _levels(max(a.shape))
    sizes = [a.shape]
    for _ in range(count):
        sizes.append(tuple((n + 1) // 2 for n in sizes[-1]))
    if count:
        a[0, 0] = _near(a[0, 0], 4 << (count - 1))
    for level in reversed(range(count)):
        (nx, ny), step, down = sizes[level], 1 << level, 1 if level else 2
        px, py, sx, sy = nx // 2, ny // 2, (nx + 1) // 2, (ny + 1) // 2
        b, out = a[:nx, :ny], np.empty((nx, ny), np.int64)
        hx, hy, hc = _near(b[sx:, :py], 2 * step), _near(b[:px, sy:], 2 * step), _near(b[sx:, sy:], step) if step > 1 else b[sx:, sy:]
        odd = hc & step
        hx, hy = _toward(hx, odd), _toward(hy, odd)
        h0, two = b[:px, :py], (hc ^ hx ^ hy) & (2 * step)
        h0 = np.where(h0 >= 0, h0 + odd - two, h0 + np.where(odd == 0, two, odd - two))
        for i, x in enumerate((-hx, hx)):
            for j, y in enumerate((-hy, hy)):
                out[i : 2 * px : 2, j : 2 * py : 2] = (h0 + x + y + (hc if i == j else -hc)) >> down
        if ny % 2:
            d = _near(b[sx:, py], 2 * step)
            s = _toward(b[:px, py], d & (2 * step))
            out[0 : 2 * px : 2, -1], out[1 : 2 * px : 2, -1] = (s - d) >> down, (s + d) >> down
        if nx % 2:
            d = _near(b[px, sy:], 2 * step)
            s = _toward(b[px, :py], d & (2 * step))
            out[-1, 0 : 2 * py : 2], out[-1, 1 : 2 * py : 2] = (s - d) >> down, (s + d) >> down
        if nx % 2 and ny % 2:
            out[-1, -1] = b[px, py] >> down
        a[:nx, :ny] = out
    return a


def _quads(shape) -> list[tuple[slice, slice, int]]:
    """The four parts of a transform and which of the three bit counts each has."""
    x, y = (shape[0] + 1) // 2, (shape[1] + 1) // 2
    low, high = (slice(0, x), slice(x, None)), (slice(0, y), slice(y, None))
    return [(low[i], high[j], i + j) for i in (0, 1) for j in (0, 1)]


def _nodes(bits: np.ndarray) -> np.ndarray:
    """A node for each 2 by 2 bits; what lies beyond the edge is 0."""
    b = np.pad(bits.astype(np.uint8), ((0, bits.shape[0] % 2), (0, bits.shape[1] % 2)))
    return 8 * b[0::2, 0::2] + 4 * b[0::2, 1::2] + 2 * b[1::2, 0::2] + b[1::2, 1::2]


def _leaves(nodes: np.ndarray, shape) -> np.ndarray:
    """The bits below nodes, cut to shape."""
    out = np.zeros((2 * nodes.shape[0], 2 * nodes.shape[1]), np.uint8)
    for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        out[i::2, j::2] = (nodes >> (3 - k)) & 1
    return out[: shape[0], : shape[1]]


def encode(image: np.ndarray) -> bytes:
    """An image of two axes, without loss."""
    if image.ndim != 2 or 0 in image.shape:
        raise UnsupportedCodec("HCOMPRESS_1 needs two axes")
    a = forward(image)
    total, a[0, 0] = int(a[0, 0]), 0
    size = np.abs(a)
    planes = [0, 0, 0]
    for x, y, k in _quads(a.shape):
        planes[k] = max(planes[k], int(size[x, y].max(initial=0)).bit_length())
    text = []
    for x, y, k in _quads(a.shape):
        part = size[x, y]
        for bit in reversed(range(planes[k])):
            tree = [_nodes((part >> bit) & 1)]
            for _ in range(_levels(max(part.shape)) - 1):
                tree.append(_nodes(tree[-1] != 0))
            # From the root down, each level from its end: what is read first stands first.
            codes = "".join(CODES[v] for nodes in reversed(tree) for v in reversed(nodes.ravel().tolist()) if v)
            if tree[0].size and len(codes) // 8 >= (tree[0].size + 1) // 2:
                text.append("0000" + "".join(map("{:04b}".format, tree[0].ravel().tolist())))
            else:
                text.append("1111" + (codes or CODES[0]))
    stream = "".join(text) + "0000"
    signs = "".join("1" if v < 0 else "0" for v in a[a != 0].tolist())
    whole = "".join(s + "0" * (-len(s) % 8) for s in (stream, signs))
    return MAGIC + struct.pack(_HEAD, *a.shape, 0, total, *planes) + int(whole, 2).to_bytes(len(whole) // 8, "big")


class _Bits:
    def __init__(self, data: bytes):
        self.text, self.at = "".join(map("{:08b}".format, data)), 0

    def take(self, n: int) -> str:
        self.at += n
        if self.at > len(self.text):
            raise CorruptData("the bits end early")
        return self.text[self.at - n : self.at]

    def value(self) -> int:
        for n in range(3, 7):
            v = _VALUES.get(self.text[self.at : self.at + n])
            if v is not None:
                self.at += n
                return v
        raise CorruptData("no code of the quadtree")


def decode(data: bytes, limit: int = 1 << 28) -> np.ndarray:
    """The image of encode(), or of a coder that scaled the transform."""
    if data[:2] != MAGIC or len(data) < 25:
        raise CorruptData("no HCOMPRESS_1 data")
    nx, ny, scale, total, *planes = struct.unpack(_HEAD, data[2:25])
    if nx <= 0 or ny <= 0 or scale < 0 or max(planes) > 63:
        raise CorruptData("HCOMPRESS_1 header")
    if nx * ny > limit:
        raise LimitExceeded("tile")
    size, bits = np.zeros((nx, ny), np.int64), _Bits(data[25:])
    for x, y, k in _quads(size.shape):
        part = size[x, y]
        shapes = [part.shape]
        for _ in range(max(1, _levels(max(part.shape)))):
            shapes.append(tuple((n + 1) // 2 for n in shapes[-1]))
        for bit in reversed(range(planes[k])):
            kind = bits.take(4)
            if kind == "0000":
                nodes = np.array([int(bits.take(4), 2) for _ in range(shapes[1][0] * shapes[1][1])], np.uint8).reshape(shapes[1])
            elif kind == "1111":
                nodes = np.array([[bits.value()]], np.uint8)
                for shape in reversed(shapes[1:-1]):
                    nodes = _leaves(nodes, shape)
                    flat = nodes.ravel()
                    for i in np.flatnonzero(flat)[::-1].tolist():
                        flat[i] = bits.value()
                    nodes = flat.reshape(shape)
            else:
                raise CorruptData("a bit plane's kind")
            part |= _leaves(nodes, part.shape).astype(np.int64) << bit
    if bits.take(4) != "0000":
        raise CorruptData("the quadtrees' end")
    bits.at += -bits.at % 8
    where = np.flatnonzero(size)
    flat = size.ravel()
    flat[where] *= np.where(np.array(list(bits.take(len(where)))) == "1", -1, 1) if len(where) else 1
    a = flat.reshape(nx, ny)
    a[0, 0] = total
    if scale > 1:
        a = a * scale
    return inverse(a)
