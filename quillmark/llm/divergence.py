"""How far the sources of a language diverge: sums of differences over all pairs of sources, and the terms that stand out in each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, small, table, written
from .selection import top_rows

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Letters are lower-cased, bytes of characters beyond ASCII stay, and all else separates terms.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def _summed(lang: list[str], source: list[str], texts: list[bytes]) -> pa.RecordBatch:
    """lang, source, term, docs, n of some documents."""
    found = [terms(t) for t in texts]
    words = pa.array([w for ws in found for w in ws], pa.binary()).dictionary_encode()
    ids, width = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    pairs, times = np.unique(np.repeat(np.arange(len(texts)), [len(w) for w in found]) * width + ids, return_counts=True)  # document and term
    group = pd.MultiIndex.from_arrays([lang, source])
    number, names = group.factorize()
    keys, at = np.unique(number[pairs // width] * width + pairs % width, return_inverse=True)
    docs, n = np.bincount(at, minlength=len(keys)), np.bincount(at, weights=times, minlength=len(keys))  # sums of a batch are exact in doubles
    of = keys // width
    langs, sources = (pa.array([x[i] for x in names], pa.string()).take(pa.array(of)) for i in (0, 1))
    return pa.RecordBatch.from_arrays([langs, sources, words.dictionary.take(pa.array(keys % width)), pa.array(docs.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "source", "term", "docs", "n"])


def term_counts(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """lang, source, term, docs, n of all rows of df (lang, source, text; none null): documents that have the term, and its occurrences.

    Sums are made over some `most` bytes of text at a time, then by task, then shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], []), 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                held[0].append(lang), held[1].append(source), held[2].append(text)
                size += len(text)
                if size >= most:
                    yield _summed(*held)
                    held, size = ([], [], []), 0
        if held[0]:
            yield _summed(*held)

    found = arrow_map(df.select("lang", "source", "text"), run, "lang string, source string, term binary, docs bigint, n bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).withColumn("term", F.col("term").cast("string"))


def share(n: str, of: str, kept: str) -> Column:
    """1 + floor(SCALE (n + SMOOTH) / (of + SMOOTH kept)) of three SQL expressions, in decimals that hold every product; null without kept terms."""
    return F.expr(f"CASE WHEN {kept} > 0 THEN 1 + (cast({n} + {SMOOTH} as decimal(20,0)) * {SCALE}) div cast({of} + {SMOOTH} * {kept} as decimal(20,0)) END")


def kept_counts(df: DataFrame, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """lang, source, term, n, p, b, q, lang_n of each kept term that a group has; lang, source, v, b of every group. p, b, q: the term's share in its
    group, the share of a term that the group doesn't have (its baseline), and the term's share in its language."""
    counts = written(term_counts(df), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = written(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_all"))
    rows = written(counts.drop("docs").join(small(kept), ["lang", "term"]), "terms")
    groups = df.groupBy("lang", "source").agg(F.lit(0)).select("lang", "source")
    groups = groups.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("all_n")), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["all_n", "v", "lang_all"])
    groups = written(groups.withColumn("b", share("0", "all_n", "v")), "groups")
    rows = rows.join(small(groups), ["lang", "source"]).withColumn("p", share("n", "all_n", "v")).withColumn("q", share("lang_n", "lang_all", "v"))
    return written(rows.select("lang", "source", "term", "n", "p", "b", "q"), "shares"), groups.select("lang", "source", "v", "b")


def against_baselines(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of every two sources of a language: the sum over the source's own terms of |p - b(item)| - |b(source) - b(item)|.

    Equal shares of a group are one row first (at most as many as the square root of twice its words), and a running sum over them in order meets each baseline."""
    steps = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("c"), F.sum("p").alias("s")).withColumnRenamed("p", "at")
    steps = steps.select("lang", "source", "at", "c", "s", F.lit(None).cast("string").alias("item"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("b").alias("at"))
    asked = groups.select("lang", "source").join(other, "lang").filter("source <> item").select("lang", "source", "at", F.lit(0).alias("c"), F.lit(0).alias("s"), "item")
    every = Window.partitionBy("lang", "source")
    below = every.orderBy("at", F.col("item").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    x = steps.unionByName(asked).select("lang", "source", "at", "item", *[F.sum(c).over(w).alias(f"{c}{n}") for c in ("c", "s") for n, w in (("_all", every), ("_low", below))])
    x = x.filter("item IS NOT NULL").join(small(groups.select("lang", "source", "b")), ["lang", "source"])
    return x.select("lang", "source", "item", F.expr("(s_all - s_low) - at * (c_all - c_low) + at * c_low - s_low - c_all * abs(b - at)").alias("value"))


def _pair_sums(source: np.ndarray, term: np.ndarray, p: np.ndarray, b: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sums over common terms, by pair of sources (numbers, the lower first), of what both having it adds to the sums against baselines. Holds about `most` entries at a time."""
    order = np.lexsort((source, term))
    source, term, p, b = source[order], term[order], p[order], b[order]
    width = int(source.max(initial=0)) + 1
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, at, np.concatenate([v for _, v in held]))
        return codes // width, codes % width, total

    for i in range(1, len(term)):  # entry i with those before it of the same term, so a frequent term is no large block
        first = int(np.searchsorted(term, term[i]))
        if first < i:
            pj, bj = p[first:i], b[first:i]
            held.append((source[first:i] * width + source[i], abs(p[i] - pj) - abs(p[i] - bj) - abs(pj - b[i]) + abs(b[i] - bj)))
            n += i - first
            if n >= most:
                yield summed()
                held, n = [], 0
    if held:
        yield summed()


def in_common(shares: DataFrame, entries: int = 20_000) -> DataFrame:
    """lang, source, item, value (source before item) for sources with terms in common: what a common term adds. Blocks of about `entries` rows hold whole terms of a language, so a block gives one row for each two sources in it, not one for each term."""
    blocks = max(1, shares.count() // entries)

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        at, names = pd.factorize(x["source"], sort=True)
        found = list(_pair_sums(at.astype(np.int64), pd.factorize(x["term"])[0], x["p"].to_numpy(np.int64), x["b"].to_numpy(np.int64)))
        parts = [pd.DataFrame({"lang": key[0], "source": names[a], "item": names[c], "value": v}) for a, c, v in found]
        return pd.concat(parts) if parts else pd.DataFrame({"lang": [], "source": [], "item": [], "value": []})

    block = F.pmod(F.xxhash64("term"), F.lit(blocks))
    return shares.select("lang", "source", "term", "p", "b", block.alias("block")).groupBy("lang", "block").applyInPandas(run, "lang string, source string, item string, value bigint")


def pair_divergence(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of every two sources of a language, both ways: the sum of |p(source) - p(item)| over all kept terms.

    All terms count as missing in both at first, v |b - b'|; terms of either source then correct its own side, and common terms the pair. Only terms that occur are looked at."""
    both = groups.select("lang", F.col("source"), "v", "b").join(groups.select("lang", F.col("source").alias("item"), F.col("b").alias("c")), "lang").filter("source < item")
    parts = both.select("lang", "source", "item", F.expr("coalesce(v * abs(b - c), 0)").alias("value"))
    own = against_baselines(shares, groups)
    parts = parts.unionByName(own.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), "value")).unionByName(in_common(shares))
    one = written(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pairs")
    return one.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def divergence(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its distance to each other one (part `pair`, all of them) and the terms of
    which it has most above the language as a whole (part `term`, the first `top`).

    A language keeps the terms that at least `least_docs` of its documents have. Shares are smoothed and scaled to whole numbers (`share`). The first terms come
    from `top_rows`: histograms over the bits of the values, then over bytes of tied terms. Distances come from `pair_divergence`. Tables of sources are joined within
    a language, as every pair is asked for.

    Nulls: a null text, language or source counts as ''. Repeated rows count each. Groups without kept terms have pairs, of value 0 if the language
    keeps none. An empty table gives an empty result. Other columns have no effect, whatever their names.
    """
    x = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    shares, groups = kept_counts(x, least_docs)
    pairs = pair_divergence(shares, groups)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    above = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    first = top_rows(above, ["lang", "source"], [("value", 30)], "item", top, 4 * top)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.withColumn("part", F.lit("pair")).select(*out).unionByName(first.withColumn("part", F.lit("term")).select(*out))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of all documents."""
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS all_n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(sum(c.n), 0)::HUGEINT AS all_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN langs USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.all_n + 5 * g.v))::BIGINT AS p,
  (1 + (1000000000::HUGEINT * (k.n + 5)) // (l.all_n + 5 * l.v))::BIGINT AS q FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM every WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
