"""Each operator against a brute-force version, an exact round trip or held-out rows, and on awkward tables."""

import base64
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from astrolith.llm import ann, common, decontam, linededup, mixing, pfor, quality, sharding, simhash, tokens, urlrules, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids and texts, empty and very long texts, ties, repeated rows, names that operators use themselves."""
    rng = random.Random(3)
    base = words(rng, 60)
    rows = [(1, base, "en", "b", 1), (1, base, "en", "b", 1), (2, base, "en", None, 1), (None, base, "en", "a", 1), (None, None, None, None, None), (3, None, "en", "a", None), (4, "", "en", "a", 0), (5, " \n\t ", "de", "a", 3)]
    rows += [(6, words(rng, 30_000), "en", "c", 9), (7, "é ü\r\n日本 語\u00a0x", "fr", "c", 9), (8, "one", "en", "", 3), (9, base.replace("w1", "W1"), "en", "b", 1)]
    rows += [(10 + i, words(rng, rng.randrange(1, 80)), "en", rng.choice("abc"), 1) for i in range(60)]
    return spark.createDataFrame([(*r, 1, "s", 0.5) for r in rows], f"{DOCS}, size int, fp string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


# --- op1 ---------------------------------------------------------------------------------------


def test_segments():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = np.where(rng.random(n) < 0.005, rng.integers(0, 1 << 32, n), rng.integers(1000, 1064, n)).astype(np.uint32)
        data = pfor.pack(ids, [None, 7], [min(3, n), n - min(3, n)], 2, 5, 11)
        both = list(pfor.segments(data + b"\n" + data + b"\n"))
        assert len(both) == 2
        head, doc_ids, lengths, got = both[1]
        assert (got == ids).all() and doc_ids == [None, 7] and lengths.sum() == n and (head["partition"], head["seq"], head["base"]) == (2, 5, 11)
        if n == 5000:
            assert len(data) < 4 * n * 0.4  # 6 bits and the exceptions
    with pytest.raises(ValueError, match="no segment"):
        list(pfor.segments(b"XXXX" * 40))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    from tokenizers import Tokenizer

    text = tokens.read_tokenizer(public_tokenizers.path(name))
    own, plain, rng = tokens.Encoder(text), Tokenizer.from_str(text), random.Random(5)
    texts = ["", " ", "a  b", "a\n b", "a \nb", "a\n", "x <|endoftext|> y", "it's 's", "a.b,c ., d..e", "\u00a0 x", "\x00 a"]
    texts += ["".join(rng.choice(" \n\ta1'.,é!日\x00") for _ in range(rng.randrange(20))) for _ in range(3000)]
    texts += [words(rng, 50) + ".\n" + words(rng, 9) for _ in range(50)]
    for a in range(0, len(texts), 500):
        part = texts[a : a + 500]
        for t, ids in zip(part, own.encode(part), strict=True):
            assert np.frombuffer(ids, own.wide).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def brute_tokens(rows):
    from tokenizers import Tokenizer

    plain, at, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_tokens(spark, awkward, empty):
    got = tokens.encode_corpus(awkward, public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute_tokens(awkward.select("doc_id", "text").collect())
    assert tokens.encode_corpus(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_ids_come_back(spark, awkward):
    path = common.scratch_path(spark, "test")
    tokens.write_tokens(awkward, path, public_tokenizers.path("byte_bpe_50k.json"), 2, partitions=2)
    for r in tokens.read_tokens(spark, path, with_ids=True).collect():
        assert len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 2 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]


# --- op2 ---------------------------------------------------------------------------------------


def test_targets():
    got = mixing.targets({"b": 100, "a": 1000, None: 10, "c": 50}, [1, 2, 3], 3)
    # a weighs 1, b 2, c 3, null 1 again; b, c and null stop at three times their own.
    assert got == {"b": 300.0, "c": 150.0, None: 30.0, "a": 680.0}
    assert mixing.targets({}, [1], 3) == {} and mixing.targets({"a": 0}, [1], 3) == {"a": 0.0}


def mixed(spark, docs):
    sizes = common.written(mixing.sized(docs, "doc_id", "source", "text"), "sizes")
    return mixing.copies(sizes, mixing.plan(sizes, [1, 2, 3])).collect()


def test_mixing(spark, awkward, empty):
    rows = mixed(spark, awkward)
    assert len(rows) == awkward.count() and mixed(spark, empty) == []
    assert Counter((r["key"], r["size"]) for r in rows) == Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in awkward.collect())
    again = Counter((r["key"], r["size"], r["source"], r["copies"]) for r in mixed(spark, awkward.repartition(5)))
    assert again == Counter((r["key"], r["size"], r["source"], r["copies"]) for r in rows)
    assert all(0 <= r["copies"] <= 3 for r in rows)
    copied = Counter({(r["key"], r["size"]): 0 for r in rows})
    for r in rows:
        copied[r["key"], r["size"]] += r["copies"]
    out = mixing.mix(awkward, [1, 2, 3])
    assert out.columns == awkward.columns
    assert Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in out.collect()) == +copied


def test_mixing_in_sql(spark, awkward):
    import duckdb

    con = duckdb.connect()
    con.register("documents", awkward.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    rows = mixed(spark, awkward)
    got = Counter((r["key"], r["size"], r["source"], r["copies"], round(r["target"], 6)) for r in rows)
    found = con.execute(mixing.OP2_SQL)
    names = [x[0] for x in found.description]
    at = [names.index(n) for n in ("doc_id", "size", "source", "copies", "target")]
    assert got == Counter((*[r[i] for i in at[:4]], round(r[at[4]], 6)) for r in found.fetchall())
    assert {r["target"] / r["source_size"] for r in rows if r["source_size"]} >= {3.0}  # some sources stop at their cap


def test_mixing_is_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 2000 if i % 97 == 0 else rng.randrange(1, 90)), "en", rng.choice(["a", "b", "b", "b", "b", "c", "d", None]), 1) for i in range(1500)]
    got = mixed(spark, spark.createDataFrame(rows, DOCS))
    for own in itertools.groupby(sorted(got, key=lambda r: str(r["source"])), key=lambda r: r["source"]):
        part = list(own[1])
        taken = sum(r["copies"] * r["size"] for r in part)
        assert part[0]["source_size"] == sum(r["size"] for r in part)
        assert taken == pytest.approx(part[0]["target"], abs=max(40, 0.01 * part[0]["target"]))


def test_longer_documents_are_favoured(spark):
    rows = [(i, "w " * (800 if i % 2 else 20), "en", "a", 1) for i in range(800)] + [(i, "w " * 100, "en", "b", 1) for i in range(800, 4000)]
    got = [r for r in mixed(spark, spark.createDataFrame(rows, DOCS)) if r["source"] == "a"]
    share = [np.mean([r["copies"] for r in got if r["size"] == s]) for s in (20, 800)]
    assert share[1] > share[0]


# --- op3 ---------------------------------------------------------------------------------------


def test_chi_square():
    assert ann.chi_square_cdf(15.507313, 8) == pytest.approx(0.95, abs=1e-6)
    assert ann.chi_square_quantile(0.9, 8) == pytest.approx(13.361566, abs=1e-5)


def neighbours(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for i, v in good:
        if queries(i):
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i)[:k]
            out.setdefault(i, near)
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(1500 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [None] * 16), (2400, [1.0]), (2500, [float("inf")] * 16), (None, rows[0][1]), (2600, [])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id bigint, embedding array<double>, id string, v int")
    got = defaultdict(list)
    for r in ann.search(df, df.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = neighbours(rows, lambda i: i % 50 == 0, 10)
    assert set(got) == set(want) and all(len(v) == 10 and v == sorted(v) for v in got.values())
    hits = sum(len({j for _, j in want[q]} & {j for _, j in got[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    few = df.filter("vec_id < 4")
    assert ann.search(few, few.filter("vec_id = 0"), "vec_id", "embedding", 10).count() == 3
    assert ann.search(df.limit(0), df, "vec_id", "embedding").count() == 0
    assert ann.search(df, df.limit(0), "vec_id", "embedding").count() == 0


def test_neighbours_of_repeated_queries(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    other = rng.normal(size=16).tolist()
    asked = spark.createDataFrame([rows[0], rows[0], rows[1], (1, other)], df.schema)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, asked, "vec_id", "embedding", 10, confidence=0.999999).collect())
    near = lambda q, v: [(q, n + 1, j) for n, (_, j) in enumerate(sorted((float(np.sqrt(((np.array(v) - w) ** 2).sum())), j) for j, w in rows if j != q)[:10])]
    assert got == sorted(near(0, rows[0][1]) + near(1, rows[1][1]) + near(1, other))


def test_rows_that_share_an_id_find_each_other(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    rows += [(0, rng.normal(size=16).tolist()), (0, rows[0][1]), *[(1000 + i, rows[5][1]) for i in range(400)]]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = ann.search_among(df, F.col("vec_id") % 100 == 0, "vec_id", "embedding", 10, confidence=0.999999).collect()
    want = []
    for n, (q, v) in enumerate(rows):
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(v) - w) ** 2).sum())), j) for m, (j, w) in enumerate(rows) if m != n)[:10]
            want += [(q, r + 1, j, round(d, 9)) for r, (d, j) in enumerate(near)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)


@pytest.mark.parametrize("size", [64, 1 << 14])
def test_recall_of_neighbours(spark, monkeypatch, size):
    monkeypatch.setattr(ann, "BLOCK_ROWS", size)
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.collect()]
    got = defaultdict(dict)
    for r in ann.op3(spark, FOLDER).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    hits = 0
    for q, v in rows:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in rows if j != q)[:10]
            hits += sum(j in got[q] and abs(got[q][j] - d) < 1e-9 for d, j in near)
    assert len(got) == sum(q % 100 == 0 for q, _ in rows) and hits >= 0.9 * 10 * len(got)


# --- op4 ---------------------------------------------------------------------------------------

PAGES = [(5, "http://a/x", "<p>one</p>"), (2, "http://a/y", "<p>one</p>"), (9, None, "<p>one</p>"), (3, "http://b\r\nWARC-Type: revisit", "two\r\n\r\nWARC/1.1\r\n"), (4, "u", None), (6, "u", ""), (7, "é", "é" * 50_000), (2, "http://a/y", "<p>one</p>"), (None, "n", "<p>one</p>"), (None, "n", "own"), (8, "q", "\x00\n")]


@pytest.mark.parametrize("least", [0, 5])
def test_archive(spark, least):
    pages = spark.createDataFrame([(*p, 1, "d") for p in PAGES], "page_id bigint, url string, html string, n int, digest string").repartition(3)
    path = common.scratch_path(spark, "archive")
    warc.archive(pages, path, least=least)
    got = Counter()
    for r in warc.records(spark, path).collect():
        head, body = bytes(r["header"]).decode(), bytes(r["payload"])
        kind, ref = re.search("WARC-Type: (.*)\r", head)[1], re.search("WARC-Refers-To: <urn:x-page:(.*)>", head)
        got[re.search("Record-ID: <urn:x-page:(.*)>", head)[1], body, kind, ref and ref[1]] += 1
        assert f"sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}\r\n" in head
        assert f"Content-Length: {0 if kind == 'revisit' else len(body)}\r\n" in head
    want, first = Counter(), {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in PAGES:
        body = (h or "").encode()
        again = len(body) >= least and h is not None and first.get(h or "", i) != i or (h is None or h == "") and len(body) >= least and first[""] != i
        want["" if i is None else str(i), body, "revisit" if again else "response", str(first[h or ""]) if again else None] += 1
    assert got == want
    stored = [bytes(r["payload"]) for r in spark.read.parquet(f"{path}/payloads").collect()]
    assert sorted(stored) == sorted({(h or "").encode() for _, _, h in PAGES})
    out = common.scratch_path(spark, "warc")
    warc.export(spark, path, out)
    back = Counter((bytes(r["header"]), bytes(r["block"])) for r in warc.load(spark, out).collect())
    assert back == Counter((bytes(r["header"]), b"" if r["revisit"] else bytes(r["payload"])) for r in warc.records(spark, path).collect())
    warc.archive(pages.limit(0), f"{path}-none")
    assert warc.records(spark, f"{path}-none").count() == 0


def test_changed_payloads_are_found(spark):
    path = common.scratch_path(spark, "archive")
    warc.archive(spark.createDataFrame([(1, "u", "x")], "page_id int, url string, html string"), path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"y")).write.parquet(f"{path}-bad/payloads")
    spark.read.parquet(f"{path}/records").write.parquet(f"{path}-bad/records")
    with pytest.raises(Exception, match="does not fit"):
        warc.records(spark, f"{path}-bad").collect()


# --- op5 ---------------------------------------------------------------------------------------


def brute_shards(rows, limit):
    sized = [(k, int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16), len((t or "").encode())) for k, t in rows]
    out, open_ = [], [("", sized)]
    while open_:
        name, own = open_.pop()
        if sum(s for *_, s in own) <= limit or len(name) == 60:
            out += [(k, s, name) for k, _, s in own]
        else:
            for bit in "01":
                part = [r for r in own if f"{r[1]:060b}"[len(name)] == bit]
                if part:
                    open_.append((name + bit, part))
    return out


@pytest.mark.parametrize("limit", [1 << 30, 3000, 700])
def test_shards(spark, awkward, limit):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = sharding.assign(awkward, limit).collect()
    assert Counter((r["doc_id"], r["bytes"], r["shard"]) for r in got) == Counter(brute_shards(rows, limit))
    sums = Counter()
    for r in got:
        sums[r["shard"], r["page"]] += r["bytes"]
        assert r["depth"] == len(r["shard"])
    biggest = {(r["shard"], r["page"]): r["bytes"] for r in got if r["bytes"] > limit}
    assert all(n <= limit or biggest.get(k) == n for k, n in sums.items())


def test_written_shards(spark, awkward, empty):
    path = common.scratch_path(spark, "shards")
    sharding.write_shards(awkward.filter("doc_id > 10"), path, 2000)
    back = spark.read.parquet(path)
    assert Counter(r["doc_id"] for r in back.collect()) == Counter(r["doc_id"] for r in awkward.filter("doc_id > 10").collect())
    assert max(r["n"] for r in back.groupBy("shard", "page").agg(F.sum(F.octet_length("text")).alias("n")).collect()) <= 2000
    assert sharding.assign(empty, 10).count() == 0


def test_written_shards_keep_every_row(spark, awkward):
    rng = random.Random(7)
    rows = [(None if i % 3 == 0 else i % 5, words(rng, rng.randrange(40)), "s", i) for i in range(900)] + [(1, "y" * 3000, "s", 901), (1, "y" * 3000, "s", 901)]
    hot = spark.createDataFrame(rows, "doc_id bigint, text string, shard string, page int").repartition(4)
    for df in (awkward, hot):
        path = common.scratch_path(spark, "shards")
        sharding.write_shards(df, path, 1500)
        back = spark.read.parquet(path)
        folders = ["shard_", "page_"] if "shard" in df.columns else ["shard", "page"]
        assert back.columns == [*df.columns, *folders]
        assert Counter(map(tuple, back.select(*df.columns).collect())) == Counter(map(tuple, df.collect()))
        sums = back.groupBy(*folders).agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
        assert all((r["b"] or 0) <= 1500 or r["n"] == 1 for r in sums)
    pages = [r["page"] for r in sharding.assign(hot.filter("doc_id is null"), 300).select("page").distinct().collect()]
    assert len(pages) > 64 and max(pages) == len(pages) - 1


# --- op6 ---------------------------------------------------------------------------------------


def brute_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def test_url_rules(spark):
    rules = [*urlrules.RULES, ("a.b.org", "", "block"), ("b.org", "/x", "allow"), ("b.org", "/x/y", "block"), ("b.org", "/x/y/z", "allow"), ("org", "/x/y/zz", "block"), ("com", "/é", "block")]
    rng = random.Random(4)
    urls = [None, "", "no scheme", "http://", "http://B.org", "x://A.b.ORG?q", "http://b.org/x/y/zz#f", "http://b.org/x/y/z", "http://nb.org/x", "http://com/en/", "http://com/é/", "a://b://c/d", "http://" + "." * 3000 + "com/en/1", "http://x.com/" + "y" * 50_000, "http://b.org/x\n/y"]
    urls += [f"http://{rng.choice(['', 'www.', 'a.'])}{rng.choice(['example', 'b'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'x'])}/{rng.choice(['7', '8', 'y', 'y/z', ''])}{rng.randrange(9)}" for _ in range(400)]
    rows = [*enumerate(urls), (3, urls[3]), (3, urls[3]), (None, "http://com/en/1")]
    df = spark.createDataFrame([(i, u, "h", "p", "g") for i, u in rows], "page_id bigint, url string, host string, path string, domain string").repartition(4)
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"), "page_id", "url").collect())
    assert got == Counter((i, *brute_verdict(u, rules)) for i, u in rows)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urlrules.judge(df, none, "page_id", "url").collect()} == {"allow"}
    assert urlrules.judge(df.limit(0), none, "page_id", "url").count() == 0


# --- op7 ---------------------------------------------------------------------------------------


def brute_lines(rows):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.md5((rows[i][1] or "").encode()).hexdigest() if rows[i][0] is None else ""))
    gone = defaultdict(set)
    for i in order:
        k, t = rows[i]
        lines = (t or "").split("\n")
        full = [j for j, x in enumerate(lines) if x.strip(" ")]
        name = (k, hashlib.md5((t or "").encode()).hexdigest() if k is None else "")
        for a in range(len(full) - 2):
            w = tuple(lines[j].strip(" ") for j in full[a : a + 3])
            first = seen.setdefault(w, (name, full[a]))
            if first != (name, full[a]):
                gone[i] |= set(range(full[a], full[a + 2] + 1))
    for i, (k, t) in enumerate(rows):
        if i in gone:
            lines = t.split("\n")
            out.append((k, "\n".join(x for j, x in enumerate(lines) if j not in gone[i]), sum(bool(lines[j].strip(" ")) for j in gone[i])))
        else:
            out.append((k, t, 0))
    return out


def test_line_dedup(spark, empty):
    rng = random.Random(6)
    pool = [f"line {i}" for i in range(25)]
    rows = [(i, "\n".join(rng.choice(["", "  ", *pool]) for _ in range(rng.randrange(0, 30)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "a\na\na\na\na\nb"), (203, "x\n\ny\nz"), (204, " x\ny \n\n z\nrest"), (3, rows[3][1]), (None, rows[5][1]), (None, rows[5][1]), (None, None), (205, "l\n" * 20_000)]
    df = spark.createDataFrame([(k, t, 1, "q") for k, t in rows], "doc_id bigint, text string, at int, spans string").repartition(3)
    got = linededup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "at", "spans", "lines_removed"]
    assert Counter((r["doc_id"], r["text"], r["lines_removed"]) for r in got.collect()) == Counter(brute_lines(rows))
    assert linededup.dedup_lines(empty).count() == 0


def test_large_sides_are_not_broadcast(spark, awkward, monkeypatch):
    rng = random.Random(6)
    pool = [f"line {i}" for i in range(25)]
    rows = [(i, "\n".join(rng.choice(["", *pool]) for _ in range(rng.randrange(0, 30)))) for i in range(120)] + [(None, "a\nb\nc\na\nb\nc")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    near = Counter(r["doc_id"] for r in simhash.near_dedup(awkward).collect())
    shards = Counter(map(tuple, sharding.assign(awkward, 700).drop("page").collect()))
    for module in (common, linededup, simhash, sharding, warc):
        monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    got = linededup.dedup_lines(df)
    assert Counter((r["doc_id"], r["text"], r["lines_removed"]) for r in got.collect()) == Counter(brute_lines(rows))
    assert Counter(r["doc_id"] for r in simhash.near_dedup(awkward).collect()) == near
    assert Counter(map(tuple, sharding.assign(awkward, 700).drop("page").collect())) == shards
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(3)
    path = common.scratch_path(spark, "archive")
    warc.archive(pages, path)
    assert sorted(bytes(r["payload"]) for r in warc.records(spark, path).collect()) == sorted((h or "").encode() for _, _, h in PAGES)


def test_too_many_sources_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 2)
    rows = [(i, "a b", "en", f"s{i}", 1) for i in range(3)]
    with pytest.raises(ValueError, match="3 sources"):
        mixing.mix(spark.createDataFrame(rows, DOCS), [1])


# --- op8 ---------------------------------------------------------------------------------------


def brute_fingerprint(text, n):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(rows, distance, n):
    fps = [brute_fingerprint(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= distance and find(a) != find(b):
            root[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, fps[i], least.get(find(i))) for i, (k, _) in enumerate(rows)]


@pytest.mark.parametrize(("distance", "chunk"), [(4, 1024), (6, 3)])
def test_simhash(spark, awkward, distance, chunk):
    rng = random.Random(8)
    base = words(rng, 300).split()
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for i in range(80):  # near copies of one text, in a chain and around it
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(99)}"
        rows.append((500 + i, " ".join(own)))
    df = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id bigint, text string, class string").repartition(3)
    got = simhash.classes(df, "doc_id", "text", distance, 4, chunk).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["class"]) for r in got) == Counter(brute_classes(rows, distance, 4))


def test_wide_fingerprints(spark):
    rng = random.Random(5)
    base = words(rng, 400).split()
    rows = [(i, " ".join(w if rng.random() > 0.02 else "zz" for w in base)) for i in range(40)] + [(100 + i, words(rng, 6)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    prints = {r["doc_id"]: [r["fp"], *r["more"]] for r in simhash.fingerprints(df, "doc_id", "text", 5, words=3).collect()}
    assert all(p[0] % (1 << 64) == brute_fingerprint(dict(rows)[k], 5) for k, p in prints.items())
    far = lambda a, b: [((x ^ y) % (1 << 64)).bit_count() for x, y in zip(prints[a], prints[b], strict=True)]
    want = {k: k for k, _ in rows}
    for _ in range(len(rows)):
        before = dict(want)
        for (a, _), (b, _) in itertools.combinations(rows, 2):
            if far(a, b)[0] <= 8 and sum(far(a, b)) <= 38:
                want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    got = {r["doc_id"]: r["class"] for r in simhash.classes(df, "doc_id", "text", 8, 5, 16, words=3, total=38).collect()}
    assert got == want and len({got[i] for i in range(40)}) < 40


def test_any_word_makes_candidates(spark):
    rng = random.Random(5)
    base = words(rng, 400).split()
    rows = [(i, " ".join(w if rng.random() > 0.02 else "zz" for w in base)) for i in range(40)] + [(100 + i, words(rng, 6)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    prints = {r["doc_id"]: [r["fp"], *r["more"]] for r in simhash.fingerprints(df, "doc_id", "text", 5, words=3).collect()}
    far = {(a, b): [((x ^ y) % (1 << 64)).bit_count() for x, y in zip(prints[a], prints[b], strict=True)] for a, b in itertools.combinations(prints, 2)}
    near = {p for p, f in far.items() if min(f) <= 8 and sum(f) <= 38}
    assert any(far[p][0] > 8 for p in near)
    want = {k: k for k in prints}
    for _ in range(len(rows)):
        before = dict(want)
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    for chunk in (16, 1024):
        got = {r["doc_id"]: r["class"] for r in simhash.classes(df, "doc_id", "text", 8, 5, chunk, words=3, total=38, keyed=3).collect()}
        assert got == want


def test_the_pipeline_finds_copies_that_are_close_in_a_later_word_only(spark):
    import corpus_pipeline

    rng, rows = random.Random(6), []
    for i in range(40):
        base = words(rng, 120, 4000).split()
        near = list(base)
        near[rng.randrange(120)], near[rng.randrange(120)] = "zz", "yy"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = {r["doc_id"]: [r["fp"], *r["more"]] for r in simhash.fingerprints(df, "doc_id", "text", 5, words=3).collect()}
    far = {i: [((x ^ y) % (1 << 64)).bit_count() for x, y in zip(prints[2 * i], prints[2 * i + 1], strict=True)] for i in range(40)}
    found = {i for i, f in far.items() if min(f) <= corpus_pipeline.DISTANCE and sum(f) <= corpus_pipeline.TOTAL}
    assert any(far[i][0] > corpus_pipeline.DISTANCE for i in found)
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, FOLDER).collect()}
    assert not {2 * i + 1 for i in found} & left


def test_near_dedup(spark, awkward, empty):
    left = simhash.near_dedup(awkward)
    want = brute_classes([(r["doc_id"], r["text"]) for r in awkward.collect()], 4, 5)
    assert left.columns == awkward.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(k for k, _, c in want if k is None or k == c)
    assert simhash.near_dedup(empty).count() == 0


def test_a_clean_text_under_the_id_of_a_near_copy_stays(spark):
    rng = random.Random(9)
    base, clean = words(rng, 80), words(rng, 80)
    rows = [(1, base, "a"), (2, base, "b"), (2, clean, "c"), (3, words(rng, 80), "d"), (4, clean, "e"), (4, None, "f"), (None, base, "g")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").repartition(3)
    for words_, total in ((1, 64), (3, 38)):
        left = simhash.near_dedup(df, words=words_, total=total, keyed=words_)
        assert left.columns == df.columns
        assert sorted(r["fp"] for r in left.collect()) == ["a", "c", "d", "f", "g"]


def test_longer_keys_for_more_rows():
    assert simhash.agreeing(1000, 4) == 2 and simhash.agreeing(10**9, 4) == 3
    assert len(simhash.block_keys(F.lit(0), 4, 3)) == 35


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(300, 300 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in common.connected(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()}
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


# --- op9 ---------------------------------------------------------------------------------------


def test_quality(spark, awkward, empty):
    rng = random.Random(9)
    good = lambda: ". ".join(words(rng, 12).capitalize() for _ in range(rng.randrange(3, 20)))
    bad = [lambda: " ".join(f"{w.upper()}!!" for w in words(rng, 80).split()), lambda: "x " * 100, lambda: " | ".join(words(rng, 60).split())]
    rows = [(i, good() if i % 3 else rng.choice(bad)(), int(i % 3 > 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(5, None, 0), (None, 1, 0), (99999, 1, 0)], "doc_id bigint, quality int, toxic int")
    stats = quality.statistics_of(docs, "doc_id", "text")
    model = quality.learn(stats, labels, train=~quality.held_out(F.col("doc_id")))
    scores = {r["doc_id"]: r["score"] for r in quality.scored(stats, model, "doc_id").collect()}
    out = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[i] >= 0.3) == bool(rows[i][2]) for i in out]) > 0.97
    odd = quality.scored(quality.statistics_of(awkward, "doc_id", "text"), model, "doc_id").collect()
    assert len(odd) == awkward.count() and all(0 <= r["score"] <= 1 for r in odd)
    kept = quality.keep_good(awkward, model, least=0.5)
    assert kept.columns == awkward.columns and kept.count() == sum(r["score"] >= 0.5 for r in odd)
    assert quality.keep_good(empty, model).count() == 0
    none = quality.learn(stats, labels.limit(0))
    assert {r["score"] for r in quality.scored(stats, none, "doc_id").collect()} == {0.5}


def test_discriminant_by_hand():
    rng = np.random.default_rng(1)
    x = {c: rng.normal(size=(400, len(quality.NAMES))) * (1 + c) + c for c in (0, 1)}
    model = quality.fit({c: (400.0, v.sum(0), v.T @ v) for c, v in x.items()}, pooled=0.0, ridge=0.0, temper=1.0)
    probe = rng.normal(size=(5, len(quality.NAMES)))
    logs = []
    for c in (0, 1):
        m, s = x[c].mean(0), np.cov(x[c].T, bias=True)
        d = probe - m
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    assert model.score(probe) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-5)


# --- op10 --------------------------------------------------------------------------------------


def brute_edit(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (v != w), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_place():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        d, x, y = decontam.edit_place(a, b)
        assert d == brute_edit(a.tolist(), b.tolist()) and 0 <= x <= y <= len(b)


def test_decontamination(spark, awkward, empty):
    rng = random.Random(12)
    items = [(i, " ".join(f"q{rng.randrange(600)}" for _ in range(rng.randrange(6, 60)))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "tiny thing"), (items[0][0], items[0][1]), (93, "!!!")]
    rows, found = [], {}
    for i in range(200):
        _, item = items[i % 40]
        w, edits = item.split(), 0
        most = int(0.2 * len(w) + 1e-9)
        for _ in range(rng.randrange(most + 1) if i % 3 else 0):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice([[], ["zz"], [w[p], "yy"]])
            edits += 1
        planted = " ".join(w).upper() if i % 5 == 0 else ", ".join(w)
        rows.append((i, f"{words(rng, rng.randrange(40))} {planted} {words(rng, rng.randrange(40))}" if i % 2 else words(rng, 70)))
        if i % 2:
            found[i, i % 40] = edits
    rows += [(300, "a TINY thing!"), (301, "tiny big thing"), (None, items[1][1]), (302, None), (303, "")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, distance int").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find(docs, bench).collect()}
    assert got.pop((300, 92)) == 0 and got.pop((None, 1)) == 0
    texts = dict(rows)
    assert set(got) <= {(d, i) for d, i in got if brute_edit(decontam.words(dict(items)[i]), decontam.words(texts[d])) == got[d, i] <= 0.2 * len(decontam.words(dict(items)[i])) + 1e-9}
    exact = {k for k, e in found.items() if e == 0}
    assert exact <= set(got) and len(set(found) & set(got)) >= 0.95 * len(found) and set(got) <= set(found)
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(k for k, _ in rows) - Counter({d for d, _ in got} | {300, None})
    assert decontam.find(awkward, bench.limit(0)).count() == 0 and decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(awkward, bench).count() == awkward.count()


def test_items_whose_rarest_words_are_all_replaced(spark):
    rng = random.Random(21)
    items = [(i, [f"q{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))]) for i in range(60)]
    often, rows = Counter(w for _, ws in items for w in set(ws)), []
    for i, ws in items:
        half, own, rare = range((len(ws) + 1) // 2), list(ws), []
        for p in sorted(half, key=lambda p: (often[ws[p]], -len(ws[p]), p)):
            if ws[p] not in rare and len(rare) < 4:
                rare.append(ws[p])
        gone = [p for p in range(len(ws)) if ws[p] in rare]
        if len(gone) > int(0.2 * len(ws) + 1e-9):
            continue
        for p in gone:
            own[p] = f"new{p}"
        rows.append((i, f"{words(rng, 30)} {' '.join(own)} {words(rng, 30)}", len(gone)))
    assert len(rows) > 30
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find(docs, bench).collect()}
    assert got == {(i, i): e for i, _, e in rows}
    assert decontam.decontaminate(docs, bench).count() == 0


def test_found_items_are_those_of_brute_force():
    rng = random.Random(22)
    items = [(i, [f"q{rng.randrange(12)}" for _ in range(rng.randrange(1, 24))]) for i in range(60)]
    texts = []
    for i in range(300):
        own = list(items[i % 60][1])
        for _ in range(rng.randrange(2 + len(own) // 4)):
            p = rng.randrange(len(own) + 1)
            own[p : p + rng.randrange(2)] = [f"q{rng.randrange(12)}"] * rng.randrange(2)
        texts.append(" ".join([*(f"q{rng.randrange(14)}" for _ in range(rng.randrange(12))), *own, *(f"q{rng.randrange(14)}" for _ in range(rng.randrange(12)))]))
    got = {(t, k): d for t, k, d, _, _ in decontam.Index(items, 0.8, 16).find(texts)}
    every = {(t, k): brute_edit(ws, decontam.words(x)) for t, x in enumerate(texts) for k, ws in items}
    assert got == {p: d for p, d in every.items() if d <= int(0.2 * len(items[p[1]][1]) + 1e-9)}


@pytest.mark.parametrize("n", [300, 800])
def test_long_items(n):
    rng = random.Random(4)
    items, texts = [(i, [f"q{rng.randrange(5000)}" for _ in range(n)]) for i in range(40)], []
    for _, ws in items:
        own = list(ws)
        for _ in range(n // 5):
            p = rng.randrange(len(own))
            own[p : p + 1] = rng.choice([[], [f"z{rng.randrange(5000)}"], [own[p], "zz"]])
        texts.append(" ".join(["a"] * 50 + own + ["b"] * 50))
    found = decontam.Index(items, 0.8, decontam.repetitions(0.8, 0.95)).find(texts)
    assert [(t, k) for t, k, *_ in found] == [(i, i) for i in range(40)] and all(d <= n // 5 for _, _, d, _, _ in found)


def test_memory_of_many_items():
    import tracemalloc

    rng = random.Random(1)
    items = [(i, [f"q{rng.randrange(100_000)}" for _ in range(rng.randrange(15, 60))]) for i in range(20_000)]
    texts = [words(rng, 400, 100_000).replace("w", "q") for _ in range(200)] + [" ".join(items[5][1])]
    tracemalloc.start()
    found = decontam.Index(items, 0.8, 16).find(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[:2] for f in found] == [(200, 5)] and most < 160e6


def test_several_blocks_and_rounds(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, words(rng, 12, 5000)) for i in range(30)]
    docs = spark.createDataFrame([(i, f"{words(rng, 9)} {items[i % 30][1] if i % 2 else ''} {words(rng, 9)}") for i in range(60)], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(tuple, decontam.find(docs, bench).collect()))
    assert len(want) == 30
    for most in (1 << 26, 1):
        monkeypatch.setattr(decontam, "BLOCK_ITEMS", 7)
        monkeypatch.setattr(decontam, "ROUND_BYTES", most)
        assert sorted(map(tuple, decontam.find(docs, bench).collect())) == want
        assert decontam.decontaminate(docs, bench).count() == 30


def test_a_recall_out_of_reach_is_an_error():
    with pytest.raises(ValueError, match="do not give a recall"):
        decontam.repetitions(0.2, 0.99)


# --- the pipeline ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(spark, awkward, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    awkward.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(10 + i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_stages(spark, awkward, empty, folder):
    import corpus_pipeline

    for docs in (awkward, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
            out.count()
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = common.written(stages["quality_classifier"](spark, docs, FOLDER), "t")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert np.mean([(k in kept) == bool(q) for k, q in labels.items()]) > 0.97
    single = common.written(stages["simhash_near_dedup"](spark, good, FOLDER), "t")
    prints = {r["doc_id"]: [r["fp"], *r["more"]] for r in simhash.fingerprints(good, "doc_id", "text", 5, words=corpus_pipeline.WORDS).collect()}
    least = {k: k for k in prints}
    for _ in range(5):  # chains are short here
        for a, b in itertools.combinations(sorted(prints), 2):
            far = [((x ^ y) % (1 << 64)).bit_count() for x, y in zip(prints[a], prints[b], strict=True)]
            if min(far) <= corpus_pipeline.DISTANCE and sum(far) <= corpus_pipeline.TOTAL:
                least[a] = least[b] = min(least[a], least[b])
    assert {r["doc_id"] for r in single.collect()} == {k for k, c in least.items() if k == c}
    clean = common.written(stages["benchmark_decontamination"](spark, single, FOLDER), "t")
    items = [" ".join(decontam.words(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in single.collect() if any(i in " ".join(decontam.words(r["text"])) for i in items)}
    assert {r["doc_id"] for r in single.collect()} - {r["doc_id"] for r in clean.collect()} == leaks
    mix = common.written(stages["source_mixing"](spark, clean, FOLDER), "t")
    final = stages["token_binary"](spark, mix, FOLDER).collect()
    assert sorted(map(tuple, final), key=lambda r: r[1]) == brute_tokens(mix.select("doc_id", "text").collect())
