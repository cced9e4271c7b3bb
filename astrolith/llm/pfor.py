"""Patched frame-of-reference segments: the bytes of a token file.

A token file is a row of segments, each followed by one line feed.  A segment is

======================  =====================================================================
``PFOR``                magic, 4 bytes
header                  11 little-endian signed 64-bit integers: length of the segment in bytes,
                        version, block size, partition, sequence number, tokens of the partition
                        before this segment, tokens, documents, blocks, packed bytes, exceptions
document ids            int64 for each document, then one byte for each (1: the id is null)
document lengths        uint32 for each document
block minima            uint32 for each block
block widths            uint8 for each block
block exceptions        uint16 for each block: how many
block starts            uint64 for each block: where it starts in the packed bytes
packed bytes            for each block, ``width`` bit planes of block size / 8 bytes
exception positions     uint16 for each exception: where in its block
exception values        uint32 for each exception: the value less the block's minimum
======================  =====================================================================

A block holds the ids less their minimum.  Its width is the number of bits that ``percentile`` of
its values fit in; wider values are patched from the exception lists.  Blocks run on over document
borders; the last one is padded with its minimum.
"""

from __future__ import annotations

import numpy as np

MAGIC, VERSION, BLOCK, PERCENTILE = b"PFOR", 1, 256, 0.98
HEADER = 11
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def bit_lengths(x: np.ndarray) -> np.ndarray:
    """How many bits each value needs; 0 for 0."""
    if x.size and x.max() < 1 << 16:
        return _BITS[x]
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, partition: int = 0, seq: int = 0, base: int = 0, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """One segment. lengths sum up to len(ids); a doc id may be None."""
    n, blocks = len(ids), -(-len(ids) // block)
    full = np.full(blocks * block, ids[-1] if n else 0, np.uint32)
    full[:n] = ids
    full = full.reshape(blocks, block)
    least = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    full = full - least[:, None]
    need = bit_lengths(full)
    at = min(block - 1, int(np.ceil(percentile * block)) - 1)
    widths = np.partition(need, at, axis=1)[:, at] if blocks else np.zeros(0, np.uint8)
    patched = need > widths[:, None]
    counts = patched.sum(axis=1, dtype=np.uint16)
    where, position = np.nonzero(patched)
    values = full[where, position]
    full[patched] = 0
    sizes = widths.astype(np.uint64) * (block // 8)
    starts = np.cumsum(sizes, dtype=np.uint64) - sizes
    packed = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        planes = np.empty((len(own), w, block // 8), np.uint8)
        lanes = full[own].astype("<u4").view(np.uint8).reshape(len(own), block, 4)
        for k in range(w):
            if k % 8 == 0:
                lane = np.ascontiguousarray(lanes[:, :, k // 8])
            plane = np.packbits(lane & np.uint8(1 << k % 8), axis=1)
            planes[:, k] = plane
        for row, start in zip(planes.reshape(len(own), -1), starts[own].tolist(), strict=True):
            packed[start : start + len(row)] = row
    parts = [
        np.array([-1 if x is None else x for x in doc_ids], "<i8"),
        np.array([x is None for x in doc_ids], np.uint8),
        np.asarray(lengths, "<u4"),
        least.astype("<u4"),
        widths,
        counts.astype("<u2"),
        starts.astype("<u8"),
        packed,
        position.astype("<u2"),
        values.astype("<u4"),
    ]
    body = b"".join(p.tobytes() for p in parts)
    total = len(MAGIC) + 8 * HEADER + len(body)
    head = np.array([total, VERSION, block, partition, seq, base, n, len(doc_ids), blocks, len(packed), len(values)], "<i8")
    return MAGIC + head.tobytes() + body


def segments(data: bytes):
    """For each segment of a token file: (header as a dict, doc ids, doc lengths, ids as uint32)."""
    names = ("total", "version", "block", "partition", "seq", "base", "tokens", "docs", "blocks", "packed", "exceptions")
    at = 0
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        head = dict(zip(names, np.frombuffer(data, "<i8", HEADER, at + 4).tolist(), strict=True))
        if head["version"] != VERSION:
            raise ValueError(f"segment version {head['version']}")
        p = at + 4 + 8 * HEADER

        def take(kind, count):
            nonlocal p
            found = np.frombuffer(data, kind, count, p)
            p += found.nbytes
            return found

        docs, blocks, block = head["docs"], head["blocks"], head["block"]
        ids, null, lengths = take("<i8", docs), take(np.uint8, docs), take("<u4", docs)
        least, widths, counts, starts = take("<u4", blocks), take(np.uint8, blocks), take("<u2", blocks), take("<u8", blocks)
        packed, position, values = take(np.uint8, head["packed"]), take("<u2", head["exceptions"]), take("<u4", head["exceptions"])
        full = np.zeros((blocks, block), np.uint32)
        for w in np.unique(widths).tolist():
            own = np.flatnonzero(widths == w)
            taken = [packed[x : x + w * (block // 8)] for x in starts[own].tolist()]
            planes = np.concatenate(taken).reshape(len(own), w, block // 8)
            lanes = np.zeros((len(own), block, 4), np.uint8)
            for k in range(w):
                if k % 8 == 0:
                    lane = np.zeros((len(own), block), np.uint8)
                lane |= np.unpackbits(planes[:, k], axis=1) << np.uint8(k % 8)
                if k % 8 == 7 or k == w - 1:
                    lanes[:, :, k // 8] = lane
            rows = lanes.reshape(len(own), 4 * block).view("<u4")
            full[own] = rows
        full[np.repeat(np.arange(blocks), counts), position] = values
        full += least[:, None]
        yield head, [None if z else x for x, z in zip(ids.tolist(), null.tolist(), strict=True)], lengths, full.reshape(-1)[: head["tokens"]]
        at += head["total"] + 1
