"""Quality by regularised quadratic discriminant analysis.

Each class (0 and 1) is a normal distribution over transformed document statistics.  Its covariance
is shrunk towards the pooled one, then towards a multiple of the identity.  The score of a document
is the logistic of the difference of the two log densities, each a Mahalanobis distance through a
Cholesky factor that is computed once, plus the log odds of the classes.

Fitting reads all labelled rows: each task adds up counts, sums and sums of products, so only a few
numbers for each task are gathered.  Scores come from the text alone.

Defined cases: null and empty texts are scored as texts of no words; rows with a null id are scored
but never learned from; a null label is no label; with no labels of one class the score is the share
of label 1 (0.5 without any labels).
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, written

#: The transformed statistics, in the order of ``statistics``.
NAMES = ("size", "lower", "upper", "marks", "digits", "repeats", "distinct", "common", "length", "spread", "other")


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of transformed statistics for each whole text: logs of smoothed shares and means."""
    import re
    from collections import Counter
    from operator import eq

    raw = np.zeros((len(texts), 11))
    low, up, dig = slice(97, 123), slice(65, 91), slice(48, 58)
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.split()  # by the six ASCII blanks
        k, n = len(words), len(data)
        byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if n else np.zeros(256, int)
        lower, upper, digits, high = int(byte[low].sum()), int(byte[up].sum()), int(byte[dig].sum()), int(byte[128:].sum())
        blanks = int(byte[9:14].sum() + byte[32])
        marks = n - lower - upper - digits - high - blanks
        plain = int(byte[44] + byte[46] + byte[39] + byte[45])  # , . ' -
        top = max(Counter(words).values()) if k else 0
        raw[i] = (
            k,
            (lower + high + 20) / (n - blanks + 24),
            (upper + 0.6) / (lower + upper + 24),
            (marks - plain + 0.2) / (k + 20),
            (digits + 0.2) / (k + 20),
            (sum(map(eq, words, words[1:])) + 0.2) / (k + 20),
            (len(set(words)) + 15) / (k + 20),
            (top + 1) / (k + 20),
            (n - blanks + 100) / (k + 20),
            (plain + 2) / (k + 20),
            (high + 1) / (n + 100),
        )
    out = np.log(np.maximum(raw, 1e-9))
    out[:, 0] = np.log1p(raw[:, 0])
    return out


def statistics_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x): x is the array of statistics of the whole text."""

    def batches(frames):
        import pyarrow as pa

        for batch in frames:
            x = np.concatenate([statistics(t) for t in slices(batch.column(1))] or [statistics([])])
            ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], [key, "x"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(lean(batches), f"`{key}` {kind}, x array<double>")


@dataclasses.dataclass
class Model:
    """What scoring needs: for each class its mean, the inverse of its Cholesky factor, a constant."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    share: float
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        logs = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) * self.temper, -700, 700)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = 0.2, ridge: float = 0.05, temper: float = 0.25) -> Model:
    """From (count, sum, sum of outer products) of each class."""
    n = {c: moments[c][0] if c in moments else 0 for c in (0, 1)}
    if not n[0] or not n[1]:
        return Model([], [], [], (n[1] / (n[0] + n[1])) if n[0] + n[1] else 0.5, temper)
    mean = {c: moments[c][1] / n[c] for c in (0, 1)}
    own = {c: moments[c][2] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)}
    both = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    means, factors, constants = [], [], []
    for c in (0, 1):
        cov = (1 - pooled) * own[c] + pooled * both
        d = len(cov)
        cov = (1 - ridge) * cov + (ridge * np.trace(cov) / d + 1e-9) * np.eye(d)
        chol = np.linalg.cholesky(cov)
        means.append(mean[c])
        factors.append(np.linalg.inv(chol))
        constants.append(float(np.log(n[c] / (n[0] + n[1])) - np.log(np.diag(chol)).sum()))
    return Model(means, factors, constants, n[1] / (n[0] + n[1]), temper)


def moments_of(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of (label, x) rows: count, sum and sum of outer products of x for each label 0 and 1."""
    d = len(NAMES)

    def batches(frames):
        import pyarrow as pa

        sums = np.zeros((2, 1 + d + d * d))
        for batch in frames:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            for c in (0, 1):
                own = x[label == c]
                sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for c in (0, 1):
            if sums[c][0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(sums.shape[1], c, np.int32)), pa.array(np.arange(sums.shape[1], dtype=np.int32)), pa.array(sums[c])], ["label", "i", "v"])

    added = rows.mapInArrow(lean(batches), "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for c in {r["label"] for r in added}:
        v = np.array([x for _, x in sorted((r["i"], r["v"]) for r in added if r["label"] == c)])
        out[c] = (float(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", train: Column | None = None) -> Model:
    """The model from stats (key, x) and all of labels whose key fulfils ``train``."""
    labels = labels.select(F.col(key), F.col(label).cast("int").alias("label")).filter("label in (0, 1)").distinct()
    rows = stats.join(labels.filter(train) if train is not None else labels, key)
    return fit(moments_of(rows.select("label", "x")))


def held_out(key: Column, folds: int = 5) -> Column:
    """crc32 of the id as text is divisible by folds; false for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def scored(stats: DataFrame, model: Model, key: str) -> DataFrame:
    """(key, score) from (key, x)."""
    d = len(NAMES)

    def batches(frames):
        import pyarrow as pa

        for batch in frames:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], [key, "score"])

    kind = stats.schema[key].dataType.simpleString()
    return stats.select(key, "x").mapInArrow(lean(batches), f"`{key}` {kind}, score double")


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs, as they are, whose score reaches ``least``; nothing is shuffled."""
    at = docs.columns.index(text)

    def batches(frames):
        import pyarrow as pa

        for batch in frames:
            score = model.score(np.concatenate([statistics(t) for t in slices(batch.column(at))] or [statistics([])]))
            yield batch.filter(pa.array(score >= least))

    return docs.mapInArrow(lean(batches), docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, held_out, score, predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = written(statistics_of(docs, "doc_id", "text"), "statistics")
    model = learn(stats, labels, train=~held_out(F.col("doc_id")))
    found = scored(stats, model, "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
