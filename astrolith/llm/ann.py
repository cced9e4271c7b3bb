"""Approximate nearest neighbours by stable projections in a kd-tree.

Every vector is projected by one fixed Gaussian matrix to a few dimensions.  For two vectors at
distance d, the squared projected distance is d^2 times a chi-square variable of that many degrees of
freedom.  A kd-tree over projected vectors is cut in two: its top, fitted on a sample of SAMPLE_ROWS
vectors at most, deals all vectors into blocks of space, and each block's part of the tree is built
over all of its vectors.  A query takes leaves in the order of their projected distance and verifies
what they hold by exact distance.  It stops when the next leaf's squared projected distance, over the
squared distance of the k-th neighbour so far, is so large that a nearer vector would project that
far with a chance below 1 - ``confidence``.

A query is sent to its own block first.  With the distance found there, the same test on the blocks'
boxes says which other blocks it is sent to, where it goes on from that distance.  So vectors are
shuffled twice, however many queries there are, and queries go only where the test sends them.  A
block that many equal vectors fill is dealt over several tasks.

Vectors that are null, zero, of another length than most (of lengths as frequent, the longest), or
hold null or non-finite parts take no part, nor do rows with a null id.  Rows that share an id are
candidates each.  With too few candidates all are given.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, task_count, written

#: Vectors in a block, vectors of the sample for the top of the tree, vectors in a leaf, leaves that are taken as one first.
BLOCK_ROWS, SAMPLE_ROWS, LEAF, BRANCH = 1 << 14, 1 << 16, 64, 16
#: The most blocks, whose boxes are sent to all tasks; above it blocks hold more vectors.
BLOCKS = 1 << 16


def chi_square_cdf(x: float, dof: int) -> float:
    """The chance that a chi-square variable of dof degrees is at most x (series of the lower gamma)."""
    if x <= 0:
        return 0.0
    a, h = dof / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16 and n < 1e5:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def chi_square_quantile(p: float, dof: int) -> float:
    """The x at which chi_square_cdf is p."""
    low, high = 0.0, dof + 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, dof) < p else (low, mid)
    return high


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all parts finite."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return F.coalesce(vec.isNotNull() & good & F.exists(vec, lambda x: x != 0), F.lit(False))


def box_distances(q, low, high):
    """Squared distances from each row of q to all boxes."""
    import numpy as np

    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[:, j] - q[:, j, None], q[:, j, None] - high[:, j]), 0)
        out += gap * gap
    return out


class Top:
    """The top of the tree: complete, split at the medians of a sample; its leaves are the blocks."""

    def __init__(self, points, blocks: int):
        import numpy as np

        self.depth = max(0, math.ceil(math.log2(max(1, blocks))))
        self.axes, self.cuts = np.zeros((1 << self.depth) - 1, np.int64), np.zeros((1 << self.depth) - 1)
        own = {0: points}
        for node in range(len(self.axes)):
            x = own.pop(node)
            if len(x):
                self.axes[node] = axis = int(np.ptp(x, axis=0).argmax())
                self.cuts[node] = np.median(x[:, axis])
            right = x[:, self.axes[node]] >= self.cuts[node]
            own[2 * node + 1], own[2 * node + 2] = x[~right], x[right]

    def block_of(self, points):
        """The block of each row."""
        import numpy as np

        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axes[node]] >= self.cuts[node])
        return node - len(self.axes)


class Tree:
    """A block's part: leaves of about LEAF rows, BRANCH neighbouring leaves to a branch, with their boxes."""

    def __init__(self, points, leaf: int = LEAF):
        import numpy as np

        order, begins = np.arange(len(points)), [0]

        def split(a, b):
            if b - a <= leaf:
                begins.append(b)
                return
            own = points[order[a:b]]
            axis, mid = int(np.ptp(own, axis=0).argmax()), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], mid)]
            split(a, a + mid)
            split(a + mid, b)

        split(0, len(points))
        self.order, self.begins = order, np.array(begins)
        boxed = points[order]
        self.low = np.minimum.reduceat(boxed, self.begins[:-1])
        self.high = np.maximum.reduceat(boxed, self.begins[:-1])
        self.branches = np.arange(0, len(self.low), BRANCH)
        self.branch_low, self.branch_high = np.minimum.reduceat(self.low, self.branches), np.maximum.reduceat(self.high, self.branches)

    def leaves(self, points, asks, branch, stop, worst):
        """(place in asks, leaf) of the leaves in branches that the test lets a query take."""
        import numpy as np

        sizes = np.minimum(self.branches[branch] + BRANCH, len(self.low)) - self.branches[branch]
        ask = np.repeat(np.arange(len(asks)), sizes)
        leaf = np.repeat(self.branches[branch] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        q = points[asks[ask]]
        gap = np.maximum(np.maximum(self.low[leaf] - q, q - self.high[leaf]), 0)
        with np.errstate(invalid="ignore"):
            near = ~((gap * gap).sum(axis=1) > stop * worst[asks[ask]])
        return asks[ask[near]], leaf[near]


def search_block(ids, names, vecs, tree, points, query_names, queries, worst, k: int, stop: float):
    """The k nearest of each query in one block: arrays (row of queries, id, distance).

    ids, names and vecs are in the tree's order; a query meets no row of its own name.  points are the
    projected queries; worst is the squared distance beyond which a query looks for nothing.  All
    queries take their next branches at once, so that a leaf meets all that ask for it in one product;
    what may be near is then measured exactly.
    """
    import numpy as np

    gaps = box_distances(points, tree.branch_low, tree.branch_high)
    order = np.argsort(gaps, axis=1, kind="stable")
    gaps = np.take_along_axis(gaps, order, axis=1)
    norms, own_norms = np.einsum("ij,ij->i", vecs, vecs), np.einsum("ij,ij->i", queries, queries)
    q, i, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    worst, at, width = worst.copy(), 0, 1
    while at < order.shape[1]:
        # The chi-square test: what lies beyond projects too far for it to be nearer than worst.
        with np.errstate(invalid="ignore"):
            go, place = np.nonzero(~(gaps[:, at : at + width] > stop * worst[:, None]))
        if not len(go):
            break
        go, leaves = tree.leaves(points, go, order[go, at + place], stop, worst)
        by_leaf = np.argsort(leaves, kind="stable")
        cuts = np.flatnonzero(np.diff(leaves[by_leaf])) + 1
        new_q, new_row = [q[:0]], [i[:0]]
        for asks in np.split(by_leaf, cuts) if len(by_leaf) else []:
            leaf, asks = leaves[asks[0]], go[asks]
            a, b = tree.begins[leaf], tree.begins[leaf + 1]
            rough = own_norms[asks, None] + norms[a:b] - 2 * (queries[asks] @ vecs[a:b].T)
            x, y = np.nonzero(rough <= (worst[asks] + 1e-9 * own_norms[asks])[:, None] + 1e-9 * norms[a:b])
            new_q.append(asks[x])
            new_row.append(y + a)
        new_q, new_row = np.concatenate(new_q), np.concatenate(new_row)
        other = names[new_row] != query_names[new_q]
        new_q, new_row = new_q[other], new_row[other]
        diff = vecs[new_row] - queries[new_q]
        q, i, d = np.concatenate([q, new_q]), np.concatenate([i, ids[new_row]]), np.concatenate([d, np.einsum("ij,ij->i", diff, diff)])
        keep = np.lexsort((i, d, q))
        q, i, d = q[keep], i[keep], d[keep]
        first = np.searchsorted(q, q)  # where the rows of the same query begin
        keep = np.arange(len(q)) - first < k
        q, i, d = q[keep], i[keep], d[keep]
        full = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
        worst[q[full]] = np.minimum(worst[q[full]], d[full])
        at, width = at + width, min(2 * width, 8)
    return q, i, np.sqrt(d)


def _good(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, v) of the rows that take part, of any length."""
    kind = "array<float>" if df.schema[vec].dataType.simpleString() == "array<float>" else "array<double>"
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(vec).cast(kind).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))


def _length(base: DataFrame) -> int | None:
    """The length of most vectors; of lengths as frequent, the longest."""
    found = base.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    return found["s"] if found else None


def _projected(df: DataFrame, size: int, dims: int, seed: int) -> DataFrame:
    """df with p, the projection of v, after its other columns."""
    names = df.columns

    def batches(frames):
        import numpy as np
        import pyarrow as pa

        proj = np.random.default_rng(seed).standard_normal((size, dims))
        for batch in frames:
            v = batch.column(names.index("v")).flatten().to_numpy().astype(np.float64).reshape(-1, size)
            p = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dims), pa.array((v @ proj).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, p], [*names, "p"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(lean(batches), kinds + ", p array<double>")


def _dealt(df: DataFrame, top: Top, dims: int, shares=None) -> DataFrame:
    """df with b, the block of p, and s: rows of a block are dealt in turn over its shares (by block), or all are 0."""
    names = df.columns

    def batches(frames):
        import numpy as np
        import pyarrow as pa

        for batch in frames:
            b = top.block_of(batch.column(names.index("p")).flatten().to_numpy().reshape(-1, dims))
            s = np.zeros(len(b), np.int64) if shares is None else np.arange(len(b)) % shares.value[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b.astype(np.int32)), pa.array(s.astype(np.int32))], [*names, "b", "s"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(lean(batches), kinds + ", b int, s int")


def _search(base: DataFrame, asked: DataFrame, size: int, k: int, dims: int, confidence: float, seed: int) -> DataFrame:
    """(q, id, rank, vec_id, score) from base (id, v, name) and asked (q, id, v, name), written tables."""
    import numpy as np

    spark, stop = base.sparkSession, chi_square_quantile(confidence, dims)
    base, asked = written(_projected(base, size, dims, seed), "vectors"), written(_projected(asked, size, dims, seed), "asked")
    n = base.count()
    sample = base.filter(F.pmod(F.xxhash64("name", "id"), F.lit(-(-n // SAMPLE_ROWS))) == 0).select("p").collect()
    parts = min(task_count(spark), -(-n // 2048))
    top = Top(np.array([r["p"] for r in sample]).reshape(-1, dims), min(BLOCKS, max(parts, -(-n // BLOCK_ROWS))))
    # A row for each block: its rows and its box.
    places = [F.get("p", F.lit(j)) for j in range(dims)]
    boxes = _dealt(base.select("p"), top, dims).groupBy("b").agg(F.count("*").alias("n"), F.array(*map(F.min, places)).alias("low"), F.array(*map(F.max, places)).alias("high")).orderBy("b").collect()
    blocks = np.array([r["b"] for r in boxes])
    even = max(1 << 10, min(BLOCK_ROWS, -(-n // len(boxes))))
    tasks = np.array([-(-r["n"] // (2 * even)) for r in boxes])
    low, high = np.array([r["low"] for r in boxes]), np.array([r["high"] for r in boxes])
    shipped = spark.sparkContext.broadcast((blocks, tasks, low, high))

    def group(table):
        import pyarrow as pa

        kind = table.column("kind").to_numpy()
        ids, names, numbers, worst = (table.column(c).to_numpy() for c in ("id", "name", "q", "worst"))
        vecs = table.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, size)
        points = table.column("p").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        own, asks = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(own) and len(asks):
            tree = Tree(points[own])
            inside = own[tree.order]
            block = ids[inside], names[inside], vecs[inside], tree
            for a in range(0, len(asks), 1024):  # bounds what is held at a time
                part = asks[a : a + 1024]
                q, i, d = search_block(*block, points[part], names[part], vecs[part], worst[part], k, stop)
                for x, y in zip(out, (numbers[part][q], i, d), strict=True):
                    x.append(y)
        return pa.table({name: np.concatenate(x) for name, x in zip(("q", "vec_id", "score"), out, strict=True)})

    def sent(first: bool):
        """Sends queries to their own block, or to the others that the test lets through; b and s name a task."""

        def batches(frames):
            import pyarrow as pa

            numbers, counts, lows, highs = shipped.value
            for batch in frames:
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    p = part.column("p").flatten().to_numpy().reshape(-1, dims)
                    gaps, worst, q = box_distances(p, lows, highs), part.column("worst").to_numpy(), part.column("q").to_numpy()
                    home = gaps.argmin(axis=1)
                    if first:
                        row, at = np.arange(len(p)), home
                        share = q % counts[at]
                    else:
                        with np.errstate(invalid="ignore"):
                            row, at = np.nonzero(~(gaps > stop * worst[:, None]))
                        many = counts[at]
                        row, at = np.repeat(row, many), np.repeat(at, many)
                        share = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                        new = ~((at == home[row]) & (share == q[row] % counts[at]))
                        row, at, share = row[new], at[new], share[new]
                    taken = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(numbers[at].astype(np.int32)), pa.array(share.astype(np.int32))], [*part.schema.names, "b", "s"])

        return lean(batches)

    shares = np.ones(1 << top.depth, np.int64)
    shares[blocks] = tasks
    held = _dealt(base, top, dims, spark.sparkContext.broadcast(shares))
    held = held.select("b", "s", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("q"), "id", "name", "v", "p", F.lit(0.0).alias("worst"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields) + ", worst double, b int, s int"

    def met(queries, first):
        to = queries.mapInArrow(sent(first), kinds)
        rows = held.unionByName(to.select("b", "s", F.lit(1).alias("kind"), "q", "id", "name", "v", "p", "worst"))
        return rows.groupBy("b", "s").applyInArrow(group, "q bigint, vec_id bigint, score double")

    near = written(met(asked.withColumn("worst", F.lit(math.inf)), True), "near")
    reach = near.groupBy("q").agg(F.when(F.count("*") >= k, F.max("score") * F.max("score")).alias("worst"))
    asked_on = asked.join(written(reach, "reach"), "q", "left").withColumn("worst", F.coalesce("worst", F.lit(math.inf)))
    found = near.unionByName(met(asked_on, False))
    # Each query has at most k rows from a task; the k nearest of these are kept.
    best = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    best = best.join(asked.select("q", "id"), "q").select("q", "id", F.posexplode("best").alias("at", "hit"))
    return best.select("q", "id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _result(spark, found: DataFrame | None) -> DataFrame:
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return found.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, key: str, vec: str, k: int = 10, dims: int = 8, confidence: float = 0.9, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest found, never a row of its own id.

    A repeated query row asks once; different query vectors under one id have a list each.
    """
    spark = vectors.sparkSession
    base = _good(vectors, key, vec)
    size = _length(base)
    if size is None:
        return _result(spark, None)
    asked = _good(queries, key, vec).filter(F.size("v") == size).distinct().select(F.xxhash64("id", "v").alias("q"), "id", "v", F.col("id").alias("name"))
    asked = written(asked, "queries")
    return _result(spark, None if asked.isEmpty() else _search(base.filter(F.size("v") == size).withColumn("name", F.col("id")), asked, size, k, dims, confidence, seed))


def search_among(vectors: DataFrame, asks: Column, key: str, vec: str, k: int = 10, dims: int = 8, confidence: float = 0.9, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that asks, by its key, its k nearest found among all other rows.

    Rows are told apart, not ids: rows that share an id ask each, and find each other.
    """
    spark = vectors.sparkSession
    base = written(_good(vectors, key, vec).withColumn("name", F.monotonically_increasing_id()), "rows")
    size = _length(base)
    if size is None:
        return _result(spark, None)
    base = base.filter(F.size("v") == size)
    own = base.withColumnRenamed("id", key).filter(asks).withColumnRenamed(key, "id")
    asked = written(own.select(F.col("name").alias("q"), "id", "v", "name"), "queries")
    return _result(spark, None if asked.isEmpty() else _search(base, asked, size, k, dims, confidence, seed))


def op3(spark, sf_dir: str) -> DataFrame:
    """Contract query: query_id, rank, vec_id, score of the ten nearest of every hundredth vector."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search_among(table, F.col("vec_id") % 100 == 0, "vec_id", "embedding", k=10)
