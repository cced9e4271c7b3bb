"""Token ids as binary files of patched frame-of-reference blocks.

Documents are range-partitioned by id, encoded where they land and written as segments (see
``pfor``) through Spark's text writer, which copies bytes as they are: the files go to any file
system that Spark writes, under its commit protocol, so that a lost executor's task is simply run
again.  Files are read back with Spark's binaryFile source.

Defined cases: a null text is empty and has the end id only; rows that share an id are encoded each,
ordered by their texts' first ``TIE_CHARS`` characters and then by a hash of the text, and may be dealt
over several files; null ids come first; an empty table gives no files and no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pfor
from .common import give_back, kept, lean, scratch_path, size_of, task_count, written

#: A segment is closed once it holds so many tokens, and a file once it holds so many segments.
SEGMENT_TOKENS, FILE_SEGMENTS = 1 << 20, 4
#: Texts are encoded so many bytes at a time, or one by one if they are longer.
BLOCK_BYTES = 1 << 21
#: A task encodes so many bytes of table at most, where that is known.
PART_BYTES = 1 << 26
#: So many first characters of the text, and its hash, order rows that share an id.
TIE_CHARS = 32
#: Once a Python worker knows so many distinct pieces it forgets those that it met in one block only.
REMEMBERED = 1 << 17


class Encoder:
    """A byte-level BPE of the tokenizers library that encodes each distinct piece of text once.

    The pre-tokenizer of a byte-level BPE never joins a visible character to white space after it, nor
    a letter or digit to an ASCII mark after it, nor such a mark, but for the apostrophe, to a letter or
    digit after it; and a single line feed between visible characters stands alone.  So texts are cut
    there and nowhere else: the ids of the pieces, one after the other, are the text's ids.  Cuts are
    found over whole blocks of bytes, and pieces are looked up by Arrow's dictionary encoding: only a
    block's distinct pieces are met in Python, and only those that are not remembered are encoded.  A
    piece that is one word of letters needs no pre-tokenizer and goes to the library's model as it is.
    """

    def __init__(self, tokenizer_json: str):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.np, self.tokenizer = np, Tokenizer.from_str(tokenizer_json)
        own = json.loads(tokenizer_json)
        pre = own.get("pre_tokenizer") or {}
        #: Cutting is only right for this kind.
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not own.get("normalizer") and not own.get("post_processor")
        self.wide = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        self.model, self.word = self.tokenizer.model, re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
        # The byte-level alphabet: printable characters of Latin-1 stand for themselves, others follow U+0100 in turn.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(0x100, 0x200))
        self.letters = "".join(chr(x if x in plain else next(others)) for x in range(256))
        byte = np.arange(256)
        self.blank = ((byte >= 9) & (byte <= 13)) | (byte == 32)
        self.visible = (byte > 32) & (byte < 127)
        self.alnum = np.array([chr(x).isalnum() and x < 128 for x in range(256)])
        self.mark = self.visible & ~self.alnum
        #: A text with one of these is encoded whole.
        self.added = [x["content"] for x in own.get("added_tokens") or []]
        self.forget()

    def forget(self) -> None:
        """Start over with nothing remembered."""
        np = self.np
        self.known: dict[str, int] = {}
        self.ids, self.begins, self.sizes = np.zeros(1 << 16, self.wide), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        self.again, self.used = np.zeros(1 << 15, bool), 0

    def forget_rare(self) -> None:
        """Keep the pieces that were met in several blocks, or none if those are too many."""
        np, n = self.np, len(self.known)
        kept, ids, begins, sizes = np.flatnonzero(self.again[:n]), self.ids, self.begins, self.sizes
        pieces = list(itertools.compress(self.known, self.again[:n].tolist()))
        self.forget()
        if 2 * len(kept) <= REMEMBERED:
            sizes, begins = sizes[kept].astype(np.int64), begins[kept]
            ends = np.cumsum(sizes)
            self._remember(pieces, ids[np.repeat(begins - ends + sizes, sizes) + np.arange(sizes.sum())], ends - sizes, sizes)

    def whole(self, texts: list[str]) -> list:
        return [self.np.array(e.ids, self.wide) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _visible_before(self, data, at):
        """Whether the character before each place is surely visible; False where that is not certain."""
        np = self.np
        last = data[at - 1]
        out, rare = self.visible[last], np.flatnonzero(last > 127)
        if len(rare):
            i, a = at[rare], last[rare]
            b, c = data[np.maximum(i - 2, 0)], data[np.maximum(i - 3, 0)]
            two = (b >= 0xC3) & (b < 0xE0)
            three = (c >= 0xE3) & (c < 0xEE) & ~((c == 0xE3) & (b == 0x80) & (a == 0x80)) | ((c == 0xE2) & (b == 0x80) & ((a >= 0x90) & (a < 0xA8) | (a >= 0xB0)))
            out[rare] = two | three
        return out

    def _visible_after(self, data, at):
        """Whether the character that begins at each place is surely visible."""
        first = data[at]
        return self.visible[first] | ((first >= 0xC3) & (first < 0xE0)) | ((first >= 0xE4) & (first < 0xEE))

    def _starts(self, data, begins):
        """Where the pieces of all texts begin."""
        np, n = self.np, len(data)
        mark = np.zeros(n + 1, bool)
        at = np.flatnonzero(self.blank[data])
        at = at[at > 0]
        seen = at[self._visible_before(data, at)]
        mark[seen] = True
        # A line feed alone, after a visible character or at a text's beginning: a piece of its own.
        first = np.zeros(n + 1, bool)
        first[begins] = True
        feeds = np.flatnonzero(data == 10)
        feeds = feeds[(mark[feeds] | first[feeds]) & (feeds < n - 1)]
        feeds = feeds[self._visible_after(data, feeds + 1)]
        mark[feeds + 1] = True
        points = np.flatnonzero(self.mark[data])
        points = points[points > 0]
        before = data[points - 1]
        latin = (data[np.maximum(points - 2, 0)] == 0xC3) & (before > 127) & (before != 0x97) & (before != 0xB7)
        mark[points[self.alnum[before] | latin]] = True
        points = points[(data[points] != 39) & (points < n - 1)] + 1
        mark[points[self.alnum[data[points]]]] = True
        mark |= first
        return np.flatnonzero(mark[:n])

    def _remember(self, pieces: list[str], ids, begins, sizes) -> None:
        """ids holds those of each piece, from begins, so many."""
        np, k, n = self.np, len(self.known), len(pieces)
        while k + n > len(self.begins):
            self.begins, self.sizes, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.sizes, self.again))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begins[k : k + n], self.sizes[k : k + n] = self.used + begins, sizes
        self.used += len(ids)
        self.known.update(zip(pieces, range(k, k + n), strict=True))

    def learn(self, new: list[str]) -> None:
        """Encode new pieces: words by the model alone, all others as texts of their own."""
        from codecs import charmap_decode

        np, word, tokenize, letters = self.np, self.word, self.model.tokenize, self.letters
        words, rest = [], []
        for x in new:
            (words if word(x) else rest).append(x)
        found = [[t.id for t in tokenize(charmap_decode(x.encode(), "strict", letters)[0])] for x in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self._remember(words, np.fromiter(itertools.chain.from_iterable(found), self.wide, int(sizes.sum())), np.cumsum(sizes) - sizes, sizes)
        if rest:
            found = self.whole(rest)
            sizes = np.array([len(x) for x in found])
            self._remember(rest, np.concatenate(found), np.cumsum(sizes) - sizes, sizes)

    def encode_block(self, texts) -> tuple:
        """Of an Arrow array of texts without nulls: all ids, and how many each text has."""
        np = self.np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.cuts:
            found = self.whole(texts.to_pylist())
            return np.concatenate([*found, np.zeros(0, self.wide)]), np.array([len(x) for x in found], np.int64)
        odd = np.zeros(len(texts), bool)
        for x in self.added:
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if odd.any():
            ids, sizes = self.encode_block(pc.if_else(pa.array(odd), "", texts))
            found, places = self.whole(texts.filter(pa.array(odd)).to_pylist()), np.flatnonzero(odd)
            ends = np.cumsum(sizes)
            ids = np.insert(ids, np.repeat(ends[places], [len(x) for x in found]), np.concatenate(found))
            sizes[places] = [len(x) for x in found]
            return ids, sizes
        begins = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        low, high = int(begins[0]), int(begins[-1])
        if low == high:
            return np.zeros(0, self.wide), np.zeros(len(texts), np.int64)
        begins, buffer = begins - low, texts.buffers()[2].slice(low, high - low)
        starts = self._starts(np.frombuffer(buffer, np.uint8), begins)
        offsets = np.append(starts, high - low).astype(np.int32)
        found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), buffer).dictionary_encode()
        pieces, at = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        if len(self.known) > REMEMBERED:
            self.forget_rare()
        rows = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        new = rows < 0
        self.again[rows[~new]] = True
        if new.any():
            own = list(itertools.compress(pieces, new.tolist()))
            self.learn(own)
            rows[new] = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
        sizes, first = self.sizes[rows][at], self.begins[rows][at]
        ends = np.cumsum(sizes, dtype=np.int64)
        ids = self.ids[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[np.searchsorted(starts, begins)]
        return ids, np.diff(upto)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian integers of type ``wide``."""
        import pyarrow as pa

        ids, sizes = self.encode_block(pa.array(texts, pa.string()))
        ends = self.np.cumsum(sizes)
        return [ids[e - n : e].tobytes() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def byte_blocks(texts, most: int):
    """(first, end) of runs of rows of at most so many bytes, or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends, a = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def encoder(tokenizer_json: str) -> Encoder:
    """The worker's encoder, kept from task to task of a stage."""
    import zlib

    def make():
        made = Encoder(tokenizer_json)
        give_back()  # reading the vocabulary takes more than holding it
        return made

    return kept(f"encoder_{zlib.crc32(tokenizer_json.encode())}", make)


def read_tokenizer(path: str) -> str:
    """The tokenizer file's text; it is sent to the executors, which need not have the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Encode the whole texts and write token files to path, in ascending order of key."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    tie = [F.substring(text, 1, TIE_CHARS).alias("p"), F.xxhash64(text).alias("x"), F.monotonically_increasing_id().alias("n")]
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), *tie)
    # Rows that share an id, equal ones too, may go to several partitions, so that no id fills one.
    rows = rows.repartitionByRange(partitions or task_count(spark, size_of(rows), PART_BYTES), "k", "p", "x", "n").sortWithinPartitions("k", "p", "x").select("k", "t")

    def batches(frames):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, me = encoder(shipped.value), TaskContext.get().partitionId()
        ids, sizes, keys, held, seq, base = [], [], [], 0, 0, 0

        def segment():
            nonlocal ids, sizes, keys, held, seq, base
            data = np.concatenate(ids)
            out = pfor.pack(data, list(itertools.chain.from_iterable(keys)), np.concatenate(sizes), me, seq, base)
            ids, sizes, keys, held, seq, base = [], [], [], 0, seq + 1, base + len(data)
            return pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["segment"])

        for batch in frames:
            for a, b in byte_blocks(batch.column(1), BLOCK_BYTES):
                texts = batch.column(1).slice(a, b - a)
                found, lengths = enc.encode_block(texts.fill_null("") if texts.null_count else texts)
                # The end id after each text's own.
                ends = np.cumsum(lengths + 1) - 1
                own, inside = np.full(len(found) + len(lengths), end_id, enc.wide), np.ones(len(found) + len(lengths), bool)
                inside[ends] = False
                own[inside] = found
                ids.append(own)
                sizes.append(lengths + 1)
                keys.append(batch.column(0).slice(a, b - a).to_pylist())
                held += len(own)
                if held >= SEGMENT_TOKENS:
                    yield segment()
        if keys:
            yield segment()

    out = rows.mapInArrow(lean(batches), "segment binary").select(F.col("segment").cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", FILE_SEGMENTS).option("lineSep", "\n").option("compression", "none").text(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the token files under path.

    partition, seq, place: where it stands; doc_id; start: ids of all documents before it;
    n_tokens; ids_crc32 of its ids as little-endian unsigned 32-bit integers; and the ids, if asked.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")

    def batches(frames):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in frames:
            for content in batch.column(0):
                for head, doc_ids, lengths, ids in pfor.segments(content.as_buffer()):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    begins, n = ends - lengths, len(lengths)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    cols = [
                        pa.array(np.full(n, head["partition"], np.int32)),
                        pa.array(np.full(n, head["seq"], np.int32)),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(begins + head["base"]),
                        pa.array(lengths.astype(np.int64)),
                        pa.array(crcs, pa.int64()),
                    ]
                    names = ["partition", "seq", "place", "doc_id", "own_start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    kinds = "partition int, seq int, place int, doc_id bigint, own_start bigint, n_tokens bigint, ids_crc32 bigint"
    docs = written(files.mapInArrow(lean(batches), kinds + (", ids array<bigint>" if with_ids else "")), "tokens-read")
    # One row for each written partition: that many rows come to the driver.
    totals = docs.groupBy("partition").agg(F.sum("n_tokens").alias("n")).orderBy("partition").collect()
    before, rows = 0, []
    for r in totals:
        rows.append((r["partition"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(rows, "partition int, before bigint"))
    found = docs.join(starts, "partition").withColumn("start", F.col("before") + F.col("own_start"))
    return found.select("partition", "seq", "place", "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def encode_corpus(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write docs as token files in the shared folder and read them back, a row per document."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, start, n_tokens, ids_crc32 of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"))
