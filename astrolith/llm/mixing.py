"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target: its weight's share of all words, at most ``cap`` times its own words; the
excess goes to the others by weight until no target is above.  With r = target / own words, a
document's expected copies are r + spread * h, where h in [-1, 1] favours longer documents and has
a word-weighted mean of zero in its source, so that expected words are the target.  The whole part
of the expected copies is certain.  The fraction p is the inclusion probability of one more copy:
documents are ranked by [u / (1 - u)] / [p / (1 - p)], u a hash of the document, and taken in this
order until the source's remaining words are filled.  The gap that the last document would overshoot
is filled by two further rounds over the documents after it that fit.

The order is an integer; the rank at which a source is full is found by rounds of partial sums
over 11 bits each.  No source is sorted or gathered, however large, and whether a document is in is
then a function of the document and of a few numbers for its source.

Defined cases: a null text has no words; documents of no words take none, whatever their copies; a
null source is a source of its own, last in order; rows that are equal in id and size share their
rank and go in together; an empty table gives no rows; more than ``SOURCES`` sources are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of, written

#: The rank has LEVELS digits of so many bits.
DIGIT = 11
LEVELS = 5
#: A source is filled in so many rounds.
ROUNDS = 3
#: Half the word count at which a document is favoured by a half.
HALF = 250
#: The most sources: a few numbers of each, and 2^DIGIT sums, are held by the driver at a time.
SOURCES = 1 << 12


def targets(sizes: dict[str | None, int], weights: list[float], cap: float) -> dict[str | None, float]:
    """Each source's target: water-filling of all words by weight, at most cap times its own.

    Sources by code point, null last, have the weights in turn, from the start again at their end.
    """
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    most = {s: cap * sizes[s] for s in order}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most[s] for s in full}
        left -= sum(most[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def _favour(size: Column) -> Column:
    """0 for none to 1000 for very long documents, in whole numbers so that sums are exact."""
    return F.floor(F.lit(1000) * size / (size + 2 * HALF)).cast("bigint")


def _uniform(key: Column, size: Column, seed: int) -> Column:
    """In (0, 1): from 48 bits of the md5 of the id, the size and the seed as text."""
    text = F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), size.cast("string"), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint") + 0.5) / float(1 << 48)


def plan(sizes: DataFrame, weights: list[float], cap: float = 3.0, spread: float = 0.25, seed: int = 7) -> DataFrame:
    """A row per source with all that decides about its documents.

    sizes has key, source, size.  What comes to the driver is a few numbers for each source, of which
    there are ``SOURCES`` at most; so the joins with what is known of sources are broadcast ones.
    """
    spark = sizes.sparkSession
    g = _favour(F.col("size"))
    stats = sizes.groupBy("source").agg(
        F.sum("size").alias("own"), F.sum(g * F.col("size")).alias("favour"), F.min(g).alias("low"), F.max(g).alias("high")
    ).collect()
    if len(stats) > SOURCES:
        raise ValueError(f"{len(stats)} sources; a mix has {SOURCES} at most")
    target = targets({r["source"]: r["own"] for r in stats}, weights, cap)
    rows = []
    for r in stats:
        own, t = r["own"], target[r["source"]]
        ratio = t / own if own else 0.0
        mean = r["favour"] / own if own else 0.0
        wide = max(r["high"] - mean, mean - r["low"])
        room = max(0.0, min(ratio, cap - ratio, 1.0))
        slope = spread * room / wide if wide > 0 and own else 0.0
        rows.append((r["source"], own, t, ratio, mean, slope))
    kinds = "source string, source_size bigint, target double, ratio double, mean double, slope double"
    known = spark.createDataFrame(rows, kinds)
    ranked = written(_ranked(sizes, known, seed).select("source", "size", "certain", "rank"), "ranked")
    certain = {r["source"]: r["n"] for r in ranked.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("n")).collect()}
    gap = {s: t - certain.get(s, 0) for s, t in target.items()}
    ranked = ranked.filter("rank is not null and size > 0")
    # The document at which a round ends would overshoot; the next round goes on after it with
    # documents that still fit, so each round leaves less than half of the gap before it.
    rounds: list[dict] = []
    for k in range(ROUNDS):
        most = {s: max(0, int(g)) if k else (1 << 62) for s, g in gap.items()}
        limit = _limits(ranked, gap, most, rounds, nearest=k == ROUNDS - 1)
        rounds.append({s: (limit.get(s, (-1, 0))[0], most[s]) for s in gap})
        gap = {s: g - limit.get(s, (-1, 0))[1] for s, g in gap.items()}
    return spark.createDataFrame([(*x, [y for r in rounds for y in r[x[0]]]) for x in rows], kinds + ", rounds array<bigint>")


def _chosen(rounds: Column, count: int) -> Column:
    """Whether one of the first rounds, a (last rank, largest size) each, takes rank and size."""
    found = F.lit(False)
    for k in range(count):
        found = found | ((F.col("rank") <= rounds[2 * k]) & (F.col("size") <= rounds[2 * k + 1]))
    return found


def _ranked(rows: DataFrame, known: DataFrame, seed: int) -> DataFrame:
    """rows (key, source, size, ...) with certain copies and the rank for one more, null if it has no chance."""
    expected = F.greatest(F.lit(0.0), F.col("ratio") + F.col("slope") * (_favour(F.col("size")) - F.col("mean")))
    rows = rows.join(F.broadcast(known), rows["source"].eqNullSafe(known["source"])).drop(known["source"])
    rows = rows.withColumn("expected", expected).withColumn("certain", F.floor(F.col("expected") + 1e-9).cast("bigint"))
    p = F.greatest(F.lit(0.0), F.col("expected") - F.col("certain"))
    u = _uniform(F.col("key"), F.col("size"), seed)
    # odds(u) / odds(p), put into (0, 1) by q / (1 + q).
    share = u * (1 - p) / (u * (1 - p) + p * (1 - u))
    rank = F.floor(share * float(1 << LEVELS * DIGIT)).cast("bigint")
    return rows.withColumn("rank", F.when(p > 1e-9, F.least(rank, F.lit((1 << LEVELS * DIGIT) - 1))))


def _limits(ranked: DataFrame, left: dict, most: dict, rounds: list[dict], nearest: bool) -> dict[str | None, tuple[int, int]]:
    """For each source the last rank that is in, and the words of all up to it.

    Of documents that no round before has taken and of at most ``most`` words: those in order of
    rank whose words stay within left, or come nearest to it.
    """
    spark = ranked.sparkSession
    state = {s: (0, 0) for s in left}  # prefix of the rank so far, words before it
    last: dict[str | None, tuple[int, int]] = {}
    kinds = "source string, prefix bigint, words bigint, want double, most bigint, rounds array<bigint>"
    for level in reversed(range(LEVELS)):
        rows = [(s, p, w, float(left[s]), most[s], [y for r in rounds for y in r[s]]) for s, (p, w) in state.items()]
        if not rows:
            break
        frame = spark.createDataFrame(rows, kinds)
        digits = ranked.join(F.broadcast(frame), ranked["source"].eqNullSafe(frame["source"])).drop(frame["source"])
        digits = digits.filter((F.shiftright("rank", DIGIT * (level + 1)) == F.col("prefix")) & (F.col("size") <= F.col("most")))
        digits = digits.filter(~_chosen(F.col("rounds"), len(rounds)))
        digits = digits.groupBy("source", F.shiftright("rank", DIGIT * level).alias("digit")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("rank").alias("rank"))
        # At most 2^DIGIT rows for each source come to the driver, however many documents it has.
        sums: dict = {}
        for r in digits.collect():
            sums.setdefault(r["source"], []).append((r["digit"], r["n"], r["rows"], r["rank"]))
        found = []
        for s, own in sums.items():
            upto, over, under = state[s][1], None, None
            for digit, n, rows, rank in sorted(own):
                upto += n
                row = {"digit": digit, "upto": upto, "n": n, "rows": rows, "rank": rank}
                if upto > left[s]:
                    over = row
                    break
                under = row
            found.append({"source": s, "over": over, "under": under})
        state = {}
        for r in found:
            s, over, under = r["source"], r["over"], r["under"]
            if over is None:  # all are in
                last[s] = ((1 << LEVELS * DIGIT) - 1 if level else under["digit"], under["upto"])
            elif level and over["rows"] > 1:
                state[s] = (over["digit"], over["upto"] - over["n"])
            else:  # what overshoots has one rank, the others below it are in
                low, words = over["rank"] - 1, over["upto"] - over["n"]
                if nearest and over["upto"] - left[s] < left[s] - words:
                    low, words = over["rank"], over["upto"]
                last[s] = (low, words)
    return last


def copies(rows: DataFrame, known: DataFrame, seed: int = 7) -> DataFrame:
    """rows (key, source, size, ...) with source_size, target and copies."""
    more = F.when(_chosen(F.col("rounds"), ROUNDS), 1).otherwise(0)
    found = _ranked(rows, known, seed).withColumn("copies", F.col("certain") + more)
    return found.drop("expected", "certain", "rank", "ratio", "mean", "slope", "rounds")


def sized(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, size) with the number of words of the whole text."""
    return docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.size(words_of(F.col(text))).cast("bigint").alias("size"))


def mix(docs: DataFrame, weights: list[float], key: str = "doc_id", source: str = "source", text: str = "text", cap: float = 3.0) -> DataFrame:
    """docs with each row as often as the mix takes it; no text is shuffled."""
    known = plan(written(sized(docs, key, source, text), "sizes"), weights, cap)
    names = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.size(words_of(F.col(text))).cast("bigint").alias("size"),
    )
    taken = copies(rows, known).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, size, source_size, target, taken of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sizes = written(sized(docs, "doc_id", "source", "text"), "sizes")
    found = copies(sizes, plan(sizes, [1, 2, 3]))
    return found.select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", F.col("copies").cast("int").alias("copies")
    )


#: The same arithmetic in SQL: water-filling over sources in order of cap by weight, then three rounds
#: of running sums by rank.
OP2_SQL = f"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), g as (
  select *, floor((1000 * size)::double / (size + {2 * HALF}))::bigint as favour from d
), s as (
  select source, sum(size)::bigint as own, sum(favour * size)::bigint as f, min(favour) as low, max(favour) as high,
    (1 + (row_number() over (order by source nulls last) - 1) % 3)::double as w from g group by source
), c as (
  select *, 3.0::double * own as most, sum(own) over ()::double as total,
    coalesce(sum(3.0::double * own) over (order by own / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
    sum(w) over (order by own / w, source nulls last rows between current row and unbounded following) as open_w from s
), m as (
  select *, (total - before) * w / open_w > most as capped from c
), t as (
  select *, case when capped then most else (total - coalesce(sum(most) filter (where capped) over (), 0)) * w / sum(w) filter (where not capped) over () end as target from m
), p as (
  select source, own, target, case when own > 0 then target / own else 0.0::double end as ratio, case when own > 0 then f::double / own else 0.0::double end as mean, low, high from t
), q as (
  select *, case when own > 0 and greatest(high - mean, mean - low) > 0
    then 0.25::double * greatest(0.0::double, least(ratio, 3.0::double - ratio, 1.0::double)) / greatest(high - mean, mean - low) else 0.0::double end as slope from p
), e as (
  select g.doc_id, g.source, g.size, q.own, q.target, greatest(0.0::double, q.ratio + q.slope * (g.favour - q.mean)) as expected
  from g join q on g.source is not distinct from q.source
), h as (
  select *, floor(expected + 1e-9::double)::bigint as certain,
    (('0x' || substr(md5(coalesce(doc_id::varchar, '') || '/' || size || '/7'), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double as u from e
), r as (
  select *, greatest(0.0::double, expected - certain) as p from h
), k as (
  select *, case when p > 1e-9::double then least(floor(u * (1 - p) / (u * (1 - p) + p * (1 - u)) * {float(1 << LEVELS * DIGIT)!r}::double)::bigint, {(1 << LEVELS * DIGIT) - 1}) end as rank from r
), b0 as (
  select source, target - sum(certain * size) as gap from k group by source, target
), x1 as (
  select k.source, rank, gap, sum(size) over (partition by k.source order by rank) as upto from k join b0 on k.source is not distinct from b0.source where rank is not null and size > 0
), l1 as (
  select b0.source, b0.gap - coalesce(max(upto) filter (where upto <= x1.gap), 0) as gap, coalesce(max(rank) filter (where upto <= x1.gap), -1) as last1
  from b0 left join x1 on b0.source is not distinct from x1.source group by b0.source, b0.gap
), x2 as (
  select k.source, rank, gap, sum(size) over (partition by k.source order by rank) as upto from k join l1 on k.source is not distinct from l1.source
  where rank > last1 and size > 0 and size <= greatest(0, trunc(gap))
), l2 as (
  select l1.source, last1, greatest(0, trunc(l1.gap)) as most2, l1.gap - coalesce(max(upto) filter (where upto <= x2.gap), 0) as gap, coalesce(max(rank) filter (where upto <= x2.gap), -1) as last2
  from l1 left join x2 on l1.source is not distinct from x2.source group by l1.source, last1, l1.gap
), x3 as (
  select k.source, rank, gap, sum(size) over (partition by k.source order by rank) as upto from k join l2 on k.source is not distinct from l2.source
  where rank > last1 and not (rank <= last2 and size <= most2) and size > 0 and size <= greatest(0, trunc(gap))
), y3 as (
  select source, gap, coalesce(max(upto) filter (where upto <= gap), 0) as words, max(rank) filter (where upto <= gap) as under, min(rank) filter (where upto > gap) as over, min(upto) filter (where upto > gap) as over_upto
  from x3 group by source, gap
), l3 as (
  select l2.source, last1, most2, last2, greatest(0, trunc(l2.gap)) as most3,
    case when over is not null and over_upto - y3.gap < y3.gap - words then over else coalesce(under, -1) end as last3 from l2 left join y3 on l2.source is not distinct from y3.source
)
select k.doc_id, k.size, k.own as source_size, k.target, k.size * c.copies as taken, k.source, c.copies::int as copies
from k join l3 on k.source is not distinct from l3.source,
  lateral (select k.certain + (coalesce(rank <= last1 or (rank <= last2 and size <= most2) or (rank <= last3 and size <= most3), false))::int as copies) c
"""
