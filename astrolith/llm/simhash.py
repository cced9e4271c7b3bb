"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is the bitwise majority over the 64-bit hashes of a text's word shingles.  Two
fingerprints that differ in at most k bits, cut into k + a blocks, agree on at least a whole blocks;
so every close pair meets in a bucket keyed by one of the (k + a choose a) choices of a blocks.  With
the pigeonhole taken twice there are fewer keys of much the same length: of blocks in g groups, k + g *
(a - 1) + 1 in all, a close pair agrees on a of some group, so only choices inside a group make keys.
Longer keys are taken for more fingerprints; the links found are the same for any a and g.
Inside a bucket the Hamming distance is verified; a wider fingerprint of several 64-bit words is
verified over all of them too, which tells short texts apart whose first words are close by chance.
The first ``keyed`` words make keys, so that a pair is found if any of these words is close.  A bucket does not give all its pairs: it gives a
spanning forest of its links, which has the same components.  Buckets above ``chunk`` rows are dealt
in chunks, and each pair of chunks is verified on its own, so no task holds a large bucket.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, ROW_BYTES, connected, forget, lean, slices, task_count, without, written

BITS = 64
#: Keys may be so many bits shorter if that makes fewer of them; rows that a task of the join has at most.
SLACK, PART_ROWS = 1.2, 1 << 22
#: Pairs that are compared at once.
PAIRS = 1 << 18


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 5, seed: int = 42, lower: bool = True, words: int = 1) -> DataFrame:
    """(key, fp, more): fp is the signed 64-bit fingerprint of the whole text, more are further words.

    The further words are made alike from hashes that are mixed from the first ones.

    A-Z are lower-cased, words are runs of all but ASCII blanks, shingles are ``shingle`` words
    joined by a space, repeats included; a shorter text is one shingle.  No words (or null): 0.
    Other columns of docs may have any names; the key itself may not be named fp or more.
    """

    def batches(frames):
        import re

        import numpy as np
        import pyarrow as pa
        import xxhash

        word = re.compile("[^\x20\x09-\x0d]+").findall
        low = {c: c + 32 for c in range(65, 91)} if lower else {}
        digest, spread = xxhash.xxh64_intdigest, 1 << 16

        def fingerprint(text):
            w = word((text or "").translate(low))
            if not w:
                return [0] * words
            n = max(1, len(w) - shingle + 1)
            ones = np.zeros((words, BITS), np.int64)
            for a in range(0, n, spread):  # very long texts: the counts are added up piece by piece
                part = w[a : a + spread + shingle - 1]
                grams = map(" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if n > 1 or len(w) == shingle else [" ".join(w)]
                h = np.fromiter((digest(g, seed) for g in grams), np.uint64)
                for k in range(words):
                    ones[k] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * k + 1)
                    h ^= h >> np.uint64(29)
            return np.packbits(2 * ones > n, axis=1).view(">i8").ravel().tolist()

        for batch in frames:
            fps = [fingerprint(t) for texts in slices(batch.column(1)) for t in texts]
            first, more = pa.array([x[0] for x in fps], pa.int64()), pa.array([x[1:] for x in fps], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), first, more], [key, "fp", "more"])

    kinds = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fp", T.LongType()), T.StructField("more", T.ArrayType(T.LongType()))])
    return docs.select(key, text).mapInArrow(lean(batches), kinds)


def node_of(words: int) -> Column:
    """A fingerprint's number; one of several words is numbered by a 64-bit hash of them."""
    return F.col("fp") if words == 1 else F.xxhash64("fp", "more")


def agreeing(count: int, distance: int) -> int:
    """How many blocks a key has, so that a bucket of random fingerprints would have 64 rows at most."""
    return next((a for a in range(2, 5) if BITS * a / (distance + a) >= math.log2(max(2, count)) - 6), 4)


def block_keys(fp: Column, distance: int, agree: int = 2, groups: int = 1) -> list[Column]:
    """For each choice of ``agree`` blocks of one group, the bits of fp inside them.

    The blocks are cut into groups, and they are ``distance`` + ``groups`` * (``agree`` - 1) + 1: of those that
    a close pair agrees on, some group then has ``agree`` at least.
    """
    n = distance + groups * (agree - 1) + 1
    ends = [BITS * i // n for i in range(n + 1)]
    masks = [((1 << ends[i + 1]) - 1) ^ ((1 << ends[i]) - 1) for i in range(n)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    parts = [masks[n * g // groups : n * (g + 1) // groups] for g in range(groups)]
    return [fp.bitwiseAND(F.lit(signed(sum(own)))) for part in parts for own in itertools.combinations(part, agree)]


def grouping(distance: int, agree: int) -> tuple[int, int]:
    """(agree, groups) of the fewest keys that are at most SLACK bits shorter than those of ``agree`` in one group."""

    def keys(a, groups):
        n = distance + groups * (a - 1) + 1
        return sum(math.comb(n * (g + 1) // groups - n * g // groups, a) for g in range(groups))

    bits = lambda a, groups: BITS * a / (distance + groups * (a - 1) + 1)
    fit = [(a, groups) for a in range(1, 9) for groups in range(1, 5) if bits(a, groups) >= bits(agree, 1) - SLACK and distance + groups * (a - 1) < BITS]
    return min(fit, key=lambda x: (keys(*x), x))


def links(fps: DataFrame, distance: int = 4, chunk: int = 1024, words: int = 1, total: int = BITS, keyed: int = 1) -> DataFrame:
    """(a, b) pairs of distinct fingerprints with the same components as all pairs within distance.

    fps: one row for each distinct fingerprint: node (its number), fp and more.  A pair is within
    distance if one of its first ``keyed`` words is and if all words together differ in at most
    ``total`` bits.
    Every such pair is found in some bucket; what is left out are only pairs that other links of the
    same bucket join already.
    """
    count = fps.count()
    agree, groups = grouping(distance, agreeing(count, distance))
    every = [F.col("fp"), *[F.get("more", F.lit(k)) for k in range(words - 1)]]
    keys = [key for word in every[:keyed] for key in block_keys(word, distance, agree, groups)]
    rows = fps.select("node", F.array(*every).alias("words"), F.posexplode(F.array(*keys)).alias("t", "bits"))
    # The word that a key is of comes first: each bucket verifies its own word and then all of them.
    first = F.floor(F.col("t") / (len(keys) // keyed)).cast("int")
    turned = [F.get("words", (first + k) % words).alias(f"w{k}") for k in range(words)]
    own = [*(["node"] if words > 1 else []), *[f"w{k}" for k in range(words)]]
    # A bucket is a 64-bit hash of its key: rows are as narrow as can be, and all pairs are verified.
    rows = rows.select("node", *turned, F.xxhash64("t", "bits").alias("slot"))
    # Only buckets above chunk are dealt: they are few, so that rows are shuffled once, to their chunk pairs.
    sizes = rows.groupBy("slot").agg(F.count("*").alias("n")).filter(F.col("n") > chunk)
    sizes = written(sizes, "buckets")
    few = sizes.count() * ROW_BYTES <= BROADCAST_BYTES
    rows = rows.join(F.broadcast(sizes) if few else sizes.hint("merge"), "slot", "left")
    # Bucket rows meet as chunk pairs (i, j), i <= j: a row goes to the pairs that its chunk c is in.
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / chunk).cast("int")
    rows = rows.withColumn("c", F.pmod(F.xxhash64("node", F.lit("chunk")), chunks).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.select("slot", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", *own)
    parts = task_count(fps.sparkSession, count * len(keys), PART_ROWS)
    rows = rows.repartition(parts, "slot", "i", "j").sortWithinPartitions("slot", "i", "j", own[0])

    def batches(frames):
        import numpy as np
        import pyarrow as pa

        def forest(x, c, i, j):
            """A spanning forest of the links between the chunks i and j, or inside i, as pairs of nodes.

            x has a row for each word, after one for the nodes if those are not the words themselves.
            """
            x = x if len(x) > 1 else np.concatenate([x, x])
            both = x if i == j else np.concatenate([x[:, c == i], x[:, c == j]], axis=1)
            left, off = (both.shape[1], 0) if i == j else (int((c == i).sum()), int((c == i).sum()))
            nodes, first, more = both[0], both[1].view(np.uint64), both[2:].view(np.uint64)
            label, out, right = np.arange(len(nodes)), [], first[off:]
            step = max(1, PAIRS // max(1, len(right)))
            for a in range(0, left, step):
                far = np.bitwise_count(first[a : min(a + step, left), None] ^ right)
                x, y = np.nonzero(far <= distance)
                later = np.flatnonzero(y > x + a) if i == j else np.arange(len(x))
                x, y = x[later], y[later]
                if len(x) and len(more):
                    every = far[x, y].astype(np.int64)
                    for w in more:
                        every += np.bitwise_count(w[a + x] ^ w[off + y])
                    x, y = x[every <= total], y[every <= total]
                if not len(x):
                    continue
                for near in np.split(np.stack([x + a, y + off]), np.flatnonzero(np.diff(x)) + 1, axis=1):
                    k, near = near[0, 0], near[1]
                    new = near[label[near] != label[k]]
                    while len(new):  # at most as many steps in all as there are rows
                        out.append((nodes[k], nodes[new[0]]))
                        label[label == label[new[0]]] = label[k]
                        new = new[label[new] != label[k]]
            return out

        def done(kept):
            return forest(np.concatenate([k[0] for k in kept], axis=1), np.concatenate([k[1] for k in kept]), kept[0][2], kept[0][3])

        def table(pairs):
            both = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        last, kept = None, []
        for batch in frames:
            if not batch.num_rows:
                continue
            out = []
            slot, i, j, c, *x = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns))
            x = np.stack(x)
            change = np.flatnonzero((slot[1:] != slot[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            ends = np.concatenate([[0], change, [len(slot)]])
            # A bucket of one row gives nothing, unless it may go on in another batch.
            many = np.diff(ends) > 1
            many[[0, -1]] = True
            for a, b in zip(ends[:-1][many].tolist(), ends[1:][many].tolist(), strict=True):
                at = (int(slot[a]), int(i[a]), int(j[a]))
                if at != last and kept:
                    out += done(kept)
                    kept = []
                last = at
                kept.append((x[:, a:b], c[a:b], at[1], at[2]))
            yield table(out)
        if kept:
            yield table(done(kept))

    return rows.mapInArrow(lean(batches), "a bigint, b bigint").distinct()


def classes(docs: DataFrame, key: str, text: str, distance: int = 4, shingle: int = 5, chunk: int = 1024, words: int = 1, total: int = BITS, keyed: int = 1) -> DataFrame:
    """(key, fp, class): class is the least key that can be reached over links.

    Rows with one fingerprint are one class member each, whatever their texts: exact copies meet
    before any join.  A null key stays null and takes part by its text; if a class has only null
    keys its class is null.
    """
    return _classes(docs, key, text, distance, shingle, chunk, words, total, keyed).select(key, "fp", "class")


def _classes(docs: DataFrame, key: str, text: str, distance: int, shingle: int, chunk: int, words: int, total: int, keyed: int) -> DataFrame:
    """(key, fp, node, class), as classes gives them."""
    prints = fingerprints(docs, key, text, shingle, words=words)
    prints = written(prints.withColumn("node", node_of(words)), "fingerprints")
    distinct = written(prints.groupBy("node").agg(F.min(key).alias("least"), F.first("fp").alias("fp"), F.first("more").alias("more")), "distinct")
    joined = connected(links(distinct, distance, chunk, words, total, keyed), "components")
    known = written(joined.join(distinct.select("node", "least"), "node"), "linked")
    roots = known.groupBy("root").agg(F.min("least").alias("class"))
    linked = known.join(roots, "root").select("node", "class")
    # All other fingerprints stand alone: their least key is their class.
    alone = distinct.join(known.select("node"), "node", "left_anti").select("node", F.col("least").alias("class"))
    named = written(linked.unionByName(alone), "classes")
    forget(distinct, known)
    return prints.join(named, "node").select(key, "fp", "node", "class")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 5, words: int = 1, total: int = BITS, keyed: int = 1) -> DataFrame:
    """docs with one document left of each class: the one with the least key.

    Rows that share that key (a repeated row) all stay; rows with a null key stay.  Where rows of
    different texts share a key, each goes or stays by its own text's class.
    """
    found = _classes(docs, key, text, distance, shingle, 1024, words, total, keyed)
    found = written(found.select(key, "node", (F.col(key) > F.col("class")).alias("goes")), "found")
    gone = written(found.filter("goes").select(key).distinct(), "gone")
    left = without(docs, gone, key)
    # Keys of rows that go and rows that stay, with what stays of them.
    stay = written(_among(found.filter(~F.col("goes")).select(key, "node"), gone, [key]).distinct(), "stay")
    if stay.isEmpty():
        return left
    rows = _among(docs, written(stay.select(key).distinct(), "both"), [key])
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("of"))
    rows = fingerprints(rows, "row", "of", shingle, words=words).select("row", F.col("row")[key].alias(key), node_of(words).alias("node"))
    return left.unionByName(_among(rows, stay, [key, "node"]).select("row.*"))


def _among(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are in ids (a written table), which is broadcast only if it is small, as in without."""
    few = ids.count() * ROW_BYTES <= BROADCAST_BYTES
    return rows.join(F.broadcast(ids) if few else ids.hint("merge"), keys, "left_semi")


def op8(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, fingerprint (16 hex digits), component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = classes(docs, "doc_id", "text", distance=4, shingle=4)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("class").alias("component_id"),
    )
