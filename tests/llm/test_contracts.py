"""Each registered opN query on the smallest tables: its exact columns, and its rows against a version by brute force."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from astrolith.llm import queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def query(spark, number, columns):
    """The rows of opN; the columns that its contract names come first in ``columns``."""
    name = next(n for n in queries.QUERIES if n.startswith(f"op{number}_"))
    df = queries.QUERIES[name](spark, FOLDER)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in columns} == columns
    return df.collect()


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def test_op1(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = query(spark, 1, {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    plain, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for k, t in sorted(documents):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want


def test_op2(spark, documents):
    rows = query(spark, 2, {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})
    sizes = {k: len(WORD.findall(t or "")) for k, t in documents}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    taken, largest = Counter(), Counter()
    for r in rows:
        largest[r["source_size"], r["target"]] = max(largest[r["source_size"], r["target"]], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source_size"], r["target"]] += r["taken"]
    assert sum(t for _, t in taken) == pytest.approx(sum(sizes.values()))
    # Whole documents are taken, a dozen of each source here: half a document may be left over.
    assert all(abs(n - t) <= largest[s, t] / 2 and t <= 3 * s + 1e-6 for (s, t), n in taken.items())


def test_op4(spark):
    import base64
    import hashlib

    rows = query(spark, 4, {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"})
    pages = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    first = {}
    for i, b in sorted(pages, reverse=True):
        first[b] = i
    want = [(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]) for i, b in pages]
    assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows))) == sorted(map(str, want))


def test_op5(spark, documents):
    rows = query(spark, 5, {"doc_id": "bigint", "bytes": "bigint", "shard": "string", "depth": "int", "page": "int"})
    assert {r["doc_id"]: r["bytes"] for r in rows} == {k: len((t or "").encode()) for k, t in documents}
    sums = Counter()
    for r in rows:
        sums[r["shard"], r["page"]] += r["bytes"]
    names = [s for s, _ in sums]
    assert max(sums.values()) <= 1 << 20 and not any(a != b and b.startswith(a) for a in names for b in names)


def test_op6(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    rows = query(spark, 6, {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        url = r["url"] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fit = max(((len(h) + len(p), h + p, v) for h, p, v in rules if f".{host}".endswith(f".{h}") and path.startswith(p)), default=(0, None, "allow"))
        assert got[r["page_id"]] == (host, path, fit[1], fit[2])


def test_op7(spark, documents):
    rows = query(spark, 7, {"doc_id": "bigint", "text": "string", "lines_removed": "int"})
    got, seen = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in rows}, {}
    for k, t in sorted(documents):
        lines = (t or "").split("\n")
        full, gone = [i for i, x in enumerate(lines) if x.strip(" ")], set()
        for a in range(len(full) - 2):
            w = tuple(lines[i].strip(" ") for i in full[a : a + 3])
            if seen.setdefault(w, (k, a)) != (k, a):
                gone |= set(range(full[a], full[a + 2] + 1))
        assert got[k] == (t if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone & set(full)))


def test_op8(spark, documents):
    rows = query(spark, 8, {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    prints = {}
    for k, t in documents:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    least = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if least[a] < least[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    least[b], changed = least[a], True
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{prints[k]:016x}", least[k]) for k in prints}


def by_hand(text):
    """The transformed statistics of a text, counted one by one."""
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x09-\x0d\x20]+", data) if w]
    k, n = len(words), len(data)
    count = lambda test: sum(1 for b in data if test(b))
    lower, upper = count(lambda b: chr(b).islower() and b < 128), count(lambda b: chr(b).isupper() and b < 128)
    digits, high, blanks = count(lambda b: 48 <= b <= 57), count(lambda b: b > 127), count(lambda b: b in b"\t\n\v\f\r ")
    plain = count(lambda b: b in b",.'-")
    marks = n - lower - upper - digits - high - blanks
    repeats, top = sum(a == b for a, b in zip(words, words[1:], strict=False)), max(Counter(words).values(), default=0)
    return [
        math.log(1 + k), math.log((lower + high + 20) / (n - blanks + 24)), math.log((upper + 0.6) / (lower + upper + 24)), math.log((marks - plain + 0.2) / (k + 20)), math.log((digits + 0.2) / (k + 20)), math.log((repeats + 0.2) / (k + 20)),
        math.log((len(set(words)) + 15) / (k + 20)), math.log((top + 1) / (k + 20)), math.log((n - blanks + 100) / (k + 20)), math.log((plain + 2) / (k + 20)), math.log((high + 1) / (n + 100)),
    ]


def test_op9(spark, documents):
    rows = query(spark, 9, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    x = {k: np.array(by_hand(t)) for k, t in documents}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    own = {c: np.array([x[k] for k, q in labels.items() if q == c and k in x and not held(k)]) for c in (0, 1)}
    total = len(own[0]) + len(own[1])
    spread = {c: (v - v.mean(0)).T @ (v - v.mean(0)) / len(v) for c, v in own.items()}
    pooled = sum(len(own[c]) * spread[c] for c in (0, 1)) / total
    cov = {}
    for c in (0, 1):
        s = 0.8 * spread[c] + 0.2 * pooled
        cov[c] = 0.95 * s + (0.05 * np.trace(s) / len(s) + 1e-9) * np.eye(len(s))
    for r in rows:
        logs = []
        for c in (0, 1):
            d = x[r["doc_id"]] - own[c].mean(0)
            logs.append(math.log(len(own[c]) / total) - 0.5 * np.linalg.slogdet(cov[c])[1] - 0.5 * d @ np.linalg.solve(cov[c], d))
        want = 1 / (1 + math.exp(-min(700, max(-700, 0.25 * (logs[1] - logs[0])))))
        assert r["score"] == pytest.approx(want, abs=1e-6) and r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.3)
    assert len(rows) == len(documents)


def test_op10(spark, documents):
    rows = query(spark, 10, {"doc_id": "bigint", "item_id": "bigint", "distance": "int", "similarity": "double", "first_word": "int", "end_word": "int"})
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    items = {r["item_id"]: split(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    texts, got = {k: split(t) for k, t in documents}, {(r["doc_id"], r["item_id"]): r for r in rows}
    holders = defaultdict(set)
    for k, ws in texts.items():
        for w in set(ws):
            holders[w].add(k)
    for i, item in items.items():
        most = int(0.2 * len(item) + 1e-9)
        # A text with the item has all but ``most`` of its words.
        shared = Counter(k for w in item for k in holders[w])
        for k in [k for k, n in shared.items() if n >= len(item) - most]:
            row = [0] * (len(texts[k]) + 1)
            for n, w in enumerate(item, 1):
                new = [n]
                for j, v in enumerate(texts[k], 1):
                    new.append(min(row[j - 1] + (v != w), row[j] + 1, new[-1] + 1))
                row = new
            r = got.pop((k, i), None)
            assert (min(row) <= most) == (r is not None)
            if r is not None:
                assert r["distance"] == min(row) and r["similarity"] == pytest.approx(1 - min(row) / len(item)) and r["end_word"] - r["first_word"] >= len(item) - most
    assert not got and rows


def test_registered_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
