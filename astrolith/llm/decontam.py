"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Texts are sequences of words (runs of letters and digits, lower-cased).  The CGK random walk copies a
sequence's current word at each step and moves on if a random bit for (step, word) says so; two
sequences at a small edit distance walk in step again soon after an edit, so that their walks differ
in few steps: edit distance becomes Hamming distance.  A key samples a few steps of a walk.  Enough
repetitions, each with its own steps and one of several walks, let a pair at the largest edit
distance share a key with the wanted recall; ``repetitions`` finds how many by simulation.

Windows are as long as the items.  Each item has some anchors, its rarest words in its first half,
and a window starts at each place of a text where an anchor stands.  Edits may fall on all anchors,
and the walks of long items drift apart, so an exact rule stands beside the keys: an item with a budget of
m edits is cut into m + 1 pieces, of which any m edits leave one whole, and each place of a text where a
piece stands is a candidate too, if enough words around it are the item's.  So nothing is missed.

Where a window and an item share a key, or a piece stands, the exact edit distance of the item to the
best part of the text around it is computed; the item is found if it is at most (1 - ``similarity``)
of the item's words.

Documents are read once for each ``ROUND_BYTES`` of items, and nothing of them is shuffled.  Items are
gathered ``BLOCK_ITEMS`` at a time.  A round's blocks are sent compressed; a worker holds one block's
index at a time, kept from task to task if there is but one block.  A random bit of a walk is a product
of the step's and the word's random numbers, so that no table of bits is held.

Defined cases: null and empty texts contain nothing; items without words (or null) are never found;
items of fewer than five words must occur exactly; rows that repeat are treated each; a similarity so
low that ``MOST`` keys do not give the recall is an error.
"""

from __future__ import annotations

import dataclasses
import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, lean, written

#: Items in a block; anchors of an item; walks; steps in a key; words that are worked on at a time.
BLOCK_ITEMS, ANCHORS, WALKS, SAMPLED, BATCH_WORDS = 20_000, 4, 16, 3, 1 << 18
#: Compressed items that are sent to the executors in a round.
ROUND_BYTES = 1 << 26
#: The most words of a piece that are looked up.
PIECE_WORDS = 8
#: The least repetitions, and the most that are tried.
LEAST, MOST = 16, 1024


def words(text: str | None) -> list[str]:
    """The lower-cased runs of letters and digits."""
    import re

    return re.findall(r"\w+", (text or "").lower())


def walk(ids: np.ndarray, symbols: np.ndarray, starts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The CGK walk from each start: a row of symbols per start, a column per step.

    ids ends in padding; symbols has a random number for each symbol, steps an odd one for each step.
    The top bit of their product says whether the walk moves on.
    """
    out = np.empty((len(steps), len(starts)), ids.dtype)
    at, last = starts.copy(), len(ids) - 1
    for j, step in enumerate(steps):
        out[j] = ids[at]
        at += (symbols[out[j]] * step >> np.uint64(63)).view(np.int64)
        np.minimum(at, last, out=at)
    return out.T


def random_numbers(rng: np.random.Generator, *shape: int) -> np.ndarray:
    """Odd ones of 64 bits."""
    return rng.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def size_class(n: int) -> int:
    """Windows of n words embed as those of their class: 1.5 ** class words, rounded up."""
    return int(math.log(n) / math.log(1.5) + 1e-9) if n > 1 else 0


def class_steps(c: int) -> int:
    """A walk moves on every second step, so twice the words of the class cover its windows."""
    return 2 * math.ceil(1.5**c)


def repetitions(similarity: float, recall: float, sampled: int = SAMPLED, n: int = 32, trials: int = 300) -> int:
    """How many keys let items of n words at the largest edit distance be found with the wanted recall.

    By simulation with a fixed seed: an edited copy of a random item, in random surroundings, is met
    through each anchor that the edits left; where the walks from it agree in a share e of the
    steps, a key is shared with chance e ** sampled.  Walks of longer items drift apart more, so that
    the recall by keys alone is lower for them; there it is the pieces that find the rest.
    """
    rng = np.random.default_rng(5)
    steps = class_steps(size_class(n))
    symbols, moves = random_numbers(rng, 4096), random_numbers(rng, steps)
    rates = []
    for _ in range(trials):
        a = rng.integers(1, 4096, n).tolist()
        b = list(enumerate(a))
        for _ in range(int((1 - similarity) * n + 1e-9)):
            at, kind = int(rng.integers(0, len(b))), int(rng.integers(0, 3))
            new = [(-1, int(rng.integers(1, 4096)))]
            b[at : at + 1] = [[], new, [b[at], *new]][kind]
        after = rng.integers(1, 4096, (2, steps + 1)).tolist()
        x, y = np.array(a + after[0]), np.array([w for _, w in b] + after[1])
        place = {i: k for k, (i, _) in enumerate(b)}
        for p in rng.choice(n // 2, ANCHORS, replace=False).tolist():
            if p in place:
                one = moves[: class_steps(size_class(n - p))]
                u, v = walk(x, symbols, np.array([p]), one)[0], walk(y, symbols, np.array([place[p]]), one)[0]
                rates.append(float((u == v).mean()) ** sampled)
            else:
                rates.append(0.0)
    chances, count = np.array(rates).reshape(trials, ANCHORS), LEAST
    while float((1 - np.prod((1 - chances) ** count, axis=1)).mean()) < recall:
        count += 8
        if count > MOST:
            raise ValueError(f"{MOST} keys do not give a recall of {recall} at a similarity of {similarity}")
    return count


def budget(n: int, similarity: float) -> int:
    """The most edits with which an item of n words is found."""
    return int((1 - similarity) * n + 1e-9)


def piece_keys(columns, mix: np.uint64):
    """A number for each row's first word, first two words, and so on; different ones may share it."""
    key = np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        key = (key[: len(column)] + column.astype(np.uint64)) * mix
        key ^= key >> np.uint64(29)
        yield key * mix


def edit_place(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the piece of region nearest to item by edits of whole words."""

    def last_row(x, y, free):
        row = np.zeros(len(y) + 1, np.int64) if free else np.arange(len(y) + 1)
        step = np.arange(len(y) + 1)
        for k, w in enumerate(x.tolist()):
            new = np.empty_like(row)
            new[0] = k + 1
            np.minimum(row[:-1] + (y != w), row[1:] + 1, out=new[1:])
            row = np.minimum.accumulate(new - step) + step
        return row

    ends = last_row(item, region, True)
    end = int(ends.argmin())
    starts = last_row(item[::-1], region[:end][::-1], True)
    return int(ends[end]), end - int(starts.argmin()), end


@dataclasses.dataclass
class Index:
    """The items of a block, ready to be looked for."""

    items: list[tuple[int, list[str]]]
    similarity: float
    count: int
    seed: int = 3

    def __post_init__(self):
        from collections import Counter, defaultdict

        often = Counter(w for _, ws in self.items for w in set(ws))
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted(often))}
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in self.items]
        self.entries = []  # (item's index, anchor's place)
        for k, (_, ws) in enumerate(self.items):
            first = range(max(1, (len(ws) + 1) // 2))
            places = sorted(first, key=lambda p: (often[ws[p]], -len(ws[p]), p))
            seen = set()
            for p in places:
                if ws[p] not in seen and len(seen) < ANCHORS:
                    seen.add(ws[p])
                    self.entries.append((k, p))
        rng = np.random.default_rng(self.seed)
        self.classes = sorted({size_class(len(self.ids[k]) - p) for k, p in self.entries})
        self.steps = class_steps(self.classes[-1]) if self.classes else 0
        self.symbols, self.moves = random_numbers(rng, len(self.vocabulary) + 1), random_numbers(rng, WALKS, self.steps)
        self.anchor = np.zeros(len(self.vocabulary) + 1, bool)
        self.mix = rng.integers(1, 1 << 62, SAMPLED + 1, dtype=np.uint64) | np.uint64(1)
        self.sampled = {c: [np.sort(rng.choice(class_steps(c), min(SAMPLED, class_steps(c)), replace=False)) for _ in range(self.count)] for c in self.classes}
        for k, p in self.entries:
            self.anchor[self.ids[k][p]] = True
        pad = np.zeros(self.steps + 1, np.int64)
        flat = np.concatenate([np.concatenate([x, pad]) for x in self.ids]) if self.ids else pad
        begins = np.cumsum([0, *(len(x) + len(pad) for x in self.ids)])
        starts = np.array([begins[k] + p for k, p in self.entries], np.int64)
        of_class = defaultdict(list)
        for e, (k, p) in enumerate(self.entries):
            of_class[size_class(len(self.ids[k]) - p)].append(e)
        self.tables = {}
        for w, moves in enumerate(self.moves):
            for c in self.classes:
                own = np.array(of_class[c])
                symbols = walk(flat, self.symbols, starts[own], moves[: class_steps(c)])
                for r in range(w, self.count, WALKS):
                    keys = self.keys(symbols, c, r)
                    order = np.argsort(keys, kind="stable")
                    self.tables[c, r] = (keys[order], own[order])
        self._cut()

    def _cut(self) -> None:
        """Tables of the items' pieces by length: keys, (item's index, place) of each, and a filter by high bits."""
        from collections import defaultdict

        of_length = defaultdict(list)
        for k, x in enumerate(self.ids):
            count = budget(len(x), self.similarity) + 1
            ends = [len(x) * i // count for i in range(count + 1)]
            for a, b in itertools.pairwise(ends):
                of_length[min(b - a, PIECE_WORDS)].append((k, a))
        self.pieces = {}
        for length, places in sorted(of_length.items()):
            columns = [np.array([self.ids[k][a + i] for k, a in places], np.int64) for i in range(length)]
            *_, keys = piece_keys(columns, self.mix[-1])
            order = np.argsort(keys, kind="stable")
            width = max(16, (8 * len(places)).bit_length())
            there = np.zeros(1 << width, bool)
            there[keys >> np.uint64(64 - width)] = True
            self.pieces[length] = (keys[order], np.array(places, np.int64)[order], there, np.uint64(64 - width))

    def keys(self, symbols: np.ndarray, c: int, r: int) -> np.ndarray:
        """One number for the anchor and the sampled symbols of repetition r; different ones may share it."""
        key = symbols[:, 0].astype(np.uint64) * self.mix[-1]
        for m, j in zip(self.mix, self.sampled[c][r].tolist(), strict=False):
            key = (key ^ (key >> np.uint64(29))) * m + symbols[:, j].astype(np.uint64)
        return key

    def find(self, texts) -> list[tuple[int, int, int, int, int]]:
        """(text's index, item's index, distance, first word, word after the last) of what is found.

        An item is given once for a text: the place of least distance, the first of these.
        """
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        held, begins, size, first = [], [0], 0, 0
        for t, text in enumerate(texts):
            text = text.as_py() if hasattr(text, "as_py") else text
            ws = words(text)
            held.append(np.fromiter(map(self.vocabulary.get, ws, itertools.repeat(0)), np.int64, len(ws)))
            size += len(ws)
            begins.append(size)
            if size >= BATCH_WORDS or t == len(texts) - 1:
                self._search(np.concatenate(held), np.array(begins), first, out)
                held, begins, size, first = [], [0], 0, t + 1
        return [(t, k, *found) for (t, k), found in sorted(out.items())]

    def _whole_pieces(self, ids: np.ndarray, begins: np.ndarray) -> set[tuple[int, int, int]]:
        """(item's index, text, start) wherever a piece of an item stands and most words around are the item's."""
        longest, found = max(self.pieces, default=0), []
        for length, keys in enumerate(piece_keys([ids[i:] for i in range(min(longest, len(ids)))], self.mix[-1]), 1):
            if length not in self.pieces:
                continue
            known, places, there, shift = self.pieces[length]
            at = np.flatnonzero(there[keys >> shift])
            low, high = np.searchsorted(known, keys[at]), np.searchsorted(known, keys[at], "right")
            each = high - low
            own = places[np.repeat(low, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
            at = np.repeat(at, each)
            text = np.searchsorted(begins, at, "right") - 1
            found.append(np.stack([own[:, 0], text, at - own[:, 1]], axis=1))
        if not found or not sum(map(len, found)):
            return set()
        found, hits = np.concatenate(found), set()
        found = found[np.lexsort(found.T[::-1])]
        found = found[np.concatenate([[True], (found[1:] != found[:-1]).any(1)])]
        among = np.zeros(len(self.vocabulary) + 1, bool)
        for rows in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1):
            item = self.ids[rows[0, 0]]
            most = budget(len(item), self.similarity)
            among[item] = True
            around = np.arange(-most, len(item) + most)
            step = max(1, BATCH_WORDS // len(around))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                near = part[:, 2:] + around
                inside = (near >= begins[part[:, 1]][:, None]) & (near < begins[part[:, 1] + 1][:, None])
                enough = (among[ids[np.clip(near, 0, len(ids) - 1)]] & inside).sum(1) >= len(item) - most
                hits.update(map(tuple, part[enough].tolist()))
            among[item] = False
        return hits

    def _search(self, ids: np.ndarray, begins: np.ndarray, first: int, out: dict) -> None:
        starts, hits = np.flatnonzero(self.anchor[ids]), self._whole_pieces(ids, begins)
        # Padding after each text: a walk does not run on into the next one.
        text = np.searchsorted(begins, np.arange(len(ids)), "right") - 1
        padded = np.zeros(len(ids) + len(begins) * (self.steps + 1), np.int64)
        padded[np.arange(len(ids)) + text * (self.steps + 1)] = ids
        shift = text[starts] * (self.steps + 1)
        for a in range(0, len(starts), 1 << 14):
            part = starts[a : a + (1 << 14)]
            for w, moves in enumerate(self.moves):
                symbols = walk(padded, self.symbols, part + shift[a : a + (1 << 14)], moves)
                for c in self.classes:
                    for r in range(w, self.count, WALKS):
                        known, entries = self.tables[c, r]
                        keys = self.keys(symbols, c, r)
                        low = np.searchsorted(known, keys)
                        for x in np.flatnonzero(known[np.minimum(low, len(known) - 1)] == keys).tolist():
                            e = int(low[x])
                            while e < len(known) and known[e] == keys[x]:
                                k, p = self.entries[entries[e]]
                                # The text that the anchor stands in: the start of the item itself may lie before it.
                                t = int(np.searchsorted(begins, part[x], "right")) - 1
                                hits.add((k, t, int(part[x]) - p))
                                e += 1
        for (k, t), near in itertools.groupby(sorted(hits), key=lambda hit: hit[:2]):
            item, near = self.ids[k], [start for _, _, start in near]
            n, most = len(item), budget(len(item), self.similarity)
            # Starts of one occurrence are at most 2 * most apart: such a run is measured at once.
            cuts = [i for i in range(1, len(near)) if near[i] - near[i - 1] > 2 * most]
            for i, j in itertools.pairwise([0, *cuts, len(near)]):
                a, b = max(int(begins[t]), near[i] - most), min(int(begins[t + 1]), near[j - 1] + n + most)
                if b - a < n - most:
                    continue
                distance, x, y = edit_place(item, ids[a:b])
                found = (distance, a + x - int(begins[t]), a + y - int(begins[t]))
                if distance <= most and found < out.get((first + t, k), (n + 1, 0, 0)):
                    out[first + t, k] = found


def _blocks(items: DataFrame, item_key: str, item_text: str):
    """The items, at most BLOCK_ITEMS or so at a time, as (id, words)."""
    rows = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t")).distinct()
    count = max(1, -(-rows.count() // BLOCK_ITEMS))
    for b in range(count):
        own = rows.filter(F.pmod(F.xxhash64("i", "t"), count) == b) if count > 1 else rows
        found = sorted(((r["i"], words(r["t"])) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield [x for x in found if x[1]]


def _packed(block: list) -> bytes:
    import json
    import zlib

    return zlib.compress(json.dumps(block).encode())


def _rounds(items: DataFrame, item_key: str, item_text: str):
    """The packed blocks, ROUND_BYTES of them at a time; one empty round if there are no items."""
    blocks, size, given = [], 0, False
    for block in _blocks(items, item_key, item_text):
        if not block:
            continue
        blocks.append(_packed(block))
        size += len(blocks[-1])
        if size >= ROUND_BYTES:
            yield blocks
            blocks, size, given = [], 0, True
    if blocks or not given:
        yield blocks


def _indexes(blocks: list[bytes], similarity: float, count: int):
    """The index of each block in turn; one that is alone is kept in the worker."""
    import json
    import zlib

    def index(data):
        return Index([(i, ws) for i, ws in json.loads(zlib.decompress(data))], similarity, count)

    if len(blocks) == 1:
        yield kept(f"items_{zlib.crc32(blocks[0])}_{similarity}_{count}", lambda: index(blocks[0]))
    else:
        yield from map(index, blocks)


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """(key, item_id, distance, similarity, first_word, end_word): each item found in each row of docs."""
    count, kind, out = repetitions(similarity, recall), docs.schema[key].dataType.simpleString(), None
    names = [key, "item_id", "distance", "similarity", "first_word", "end_word"]
    kinds = f"`{key}` {kind}, item_id bigint, distance int, similarity double, first_word int, end_word int"
    for blocks in _rounds(items, item_key, item_text):
        shipped = docs.sparkSession.sparkContext.broadcast(blocks)

        def batches(frames, shipped=shipped):
            import pyarrow as pa

            for batch in frames:
                for index in _indexes(shipped.value, similarity, count):
                    rows = index.find(batch.column(1))
                    t, k, d, a, b = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else [[]] * 5))
                    ids = [index.items[x][0] for x in k.tolist()]
                    size = np.array([len(index.items[x][1]) for x in k.tolist()], float)
                    cols = [batch.column(0).take(pa.array(t)), pa.array(ids, pa.int64()), pa.array(d.astype(np.int32)), pa.array(1 - d / np.maximum(size, 1)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, names)

        found = docs.select(key, text).mapInArrow(lean(batches), kinds)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """The rows of docs, as they are, in which no item is found; nothing is shuffled.

    Between rounds, of which there is but one for all but the largest sets of items, docs are written.
    """
    count, at, first = repetitions(similarity, recall), docs.columns.index(text), True
    for blocks in _rounds(items, item_key, item_text):
        shipped = docs.sparkSession.sparkContext.broadcast(blocks)

        def batches(frames, shipped=shipped):
            import pyarrow as pa

            for batch in frames:
                clean = np.ones(batch.num_rows, bool)
                for index in _indexes(shipped.value, similarity, count):
                    clean[[t for t, *_ in index.find(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        docs = (docs if first else written(docs, "decontaminated")).mapInArrow(lean(batches), docs.schema)
        first = False
    return docs


def op10(spark, sf_dir: str) -> DataFrame:
    """Each benchmark item found in each document: doc_id, item_id, distance and place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
