"""One's-complement sums of 32-bit words and their sixteen-character form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL_ONES = 0xFFFFFFFF
#: Fixed values of the format: characters that the encoded form leaves out.
EXCLUDED = ":;<=>?@[\\]^_`"


def fold(high: Column, low: Column) -> Column:
    """The sum of words from the sums of their upper and lower 16 bits, carries brought round."""
    for _ in range(4):  # sums of up to 2^62 need no more
        carry_high, carry_low = F.shiftright(high, 16), F.shiftright(low, 16)
        high, low = high.bitwiseAND(F.lit(65535)) + carry_low, low.bitwiseAND(F.lit(65535)) + carry_high
    return high * F.lit(65536) + low


def sum_words(word: Column) -> Column:
    """The aggregate of unsigned 32-bit words: two plain sums, so it is added up before the shuffle."""
    w = word.cast("bigint")
    return fold(F.coalesce(F.sum(F.shiftright(w, 16)), F.lit(0)), F.coalesce(F.sum(w.bitwiseAND(F.lit(65535))), F.lit(0)))


def add(a: Column, b: Column) -> Column:
    """The one's-complement sum of two sums."""
    return fold(F.shiftright(a, 16) + F.shiftright(b, 16), a.bitwiseAND(F.lit(65535)) + b.bitwiseAND(F.lit(65535)))


def complement(x: Column) -> Column:
    """All bits of 32 turned."""
    return F.lit(ALL_ONES) - x


def status(found: Column, wanted: Column) -> Column:
    """match, mismatch or not_present."""
    return F.when(wanted.isNull(), "not_present").when(found == wanted, "match").otherwise("mismatch")


def encode_number(value: int) -> str:
    """The sixteen characters of a sum: each byte is spread over four characters around a quarter of it."""
    columns = []
    for byte in value.to_bytes(4, "big"):
        quarter, rest = divmod(byte, 4)
        four = [48 + quarter + rest, *[48 + quarter] * 3]
        for a, b in ((0, 1), (2, 3)):
            while chr(four[a]) in EXCLUDED or chr(four[b]) in EXCLUDED:
                four[a], four[b] = four[a] + 1, four[b] - 1
        columns.append(four)
    text = "".join(chr(columns[i][j]) for j in range(4) for i in range(4))
    return text[-1] + text[:-1]


def decode_text(text: str) -> int:
    """The sum that sixteen characters stand for."""
    straight = text[1:] + text[0]
    parts = [sum(ord(straight[4 * j + i]) - 48 for j in range(4)) & 255 for i in range(4)]
    return int.from_bytes(bytes(parts), "big")


def encode(value: Column) -> Column:
    """encode_number as an expression: the four characters of each byte are looked up in a table of 256."""
    table = [encode_number(b << 24) for b in range(256)]  # character 4j of a byte's own form is its j-th
    own = [[t[(4 * j + 1) % 16] for j in range(4)] for t in table]
    look = [F.array(*[F.lit(own[b][j]) for b in range(256)]) for j in range(4)]
    byte = lambda i: F.shiftright(value, 24 - 8 * i).bitwiseAND(F.lit(255)).cast("int")
    chars = [F.get(look[j], byte(i)) for j in range(4) for i in range(4)]
    return F.concat(chars[-1], *chars[:-1])


def words_of(data: bytes, fill: bytes = b"\0") -> int:
    """The sum of bytes, padded to whole words (for a data unit: to whole blocks, by the caller)."""
    import numpy as np

    data = bytes(data) + fill * (-len(data) % 4)
    words = np.frombuffer(data, ">u4").astype(np.uint64)
    total = int(words.sum(dtype=np.uint64)) if len(words) < 1 << 32 else sum(int(x) for x in words)
    while total >> 32:
        total = (total & ALL_ONES) + (total >> 32)
    return total


def fingerprint(df) -> Column:
    """An aggregate that changes with the content of df's rows, whatever their order: xor and sum of row hashes, and count."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return F.struct(F.bit_xor(row).alias("xor"), F.sum(row.bitwiseAND(F.lit(0xFFFFFFFF))).alias("sum"), F.count("*").alias("rows"))
