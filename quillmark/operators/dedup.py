"""Repetition inside texts and duplicates between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import arrow_map


def exact_duplicates(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: total, distinct, duplicate_rate. Equal texts meet as digests, summed in the tasks first."""
    one = df.groupBy(F.sha2(F.col(text), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return one.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_texts")).withColumn("duplicate_rate", F.round(1 - F.col("distinct_texts") / F.col("total"), 6))


def line_facts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, norm, first, n: each distinct line of each text, stripped, with its first place and number."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return lines.withColumn("norm", T.stripped(F.col("line"))).filter("norm <> ''").groupBy(key, "norm").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))


def boilerplate(df: DataFrame, key: str, text: str = "text", least: int = 3) -> DataFrame:
    """key, repeated_lines, removed_lines and four flags by text; a line that occurs `least` times or more is kept where it is first."""
    x = line_facts(df, key, text).filter(F.col("n") >= least)
    low = F.lower("norm")
    footer = F.rlike(low, F.lit("copyright|confidential|proprietary|all rights reserved"))
    nav = F.rlike("norm", F.lit(r"(?i)^\s*\d+\.\s+|^\s*[A-Z][a-z]+\s+\.{3,}|^\s*Chapter\s+\d+"))
    return x.groupBy(key).agg(
        F.count(F.lit(1)).alias("repeated_lines"), F.sum(F.col("n") - 1).alias("removed_lines"), F.bool_or(F.contains(low, F.lit("page")) & F.rlike("norm", F.lit(r"\d"))).alias("page_numbers"),
        F.bool_or(F.length("norm") < 100).alias("headers"), F.bool_or(footer).alias("footers"), F.bool_or(nav).alias("nav"),
    )


def without_boilerplate(df: DataFrame, key: str, text: str = "text", least: int = 3) -> DataFrame:
    """key and the text with each line that occurs `least` times or more kept where it is first. Lines are sorted inside one row, without a shuffle."""
    lines = F.split(F.col(text), "\n")
    norm = F.transform(lines, lambda x: F.nullif(T.stripped(x), F.lit("")))
    kept = F.filter(F.arrays_zip(lines.alias("line"), T.repeats(norm, least).alias("again")), lambda x: ~x["again"])
    return df.select(key, F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"))


def without_repeated_ngrams(df: DataFrame, key: str, text: str = "text", n: int = 4, least: int = 3) -> DataFrame:
    """key, text: a word goes if the n-gram that starts at it occurs `least` times or more and has occurred before. All inside one row; texts without words go."""

    def kept(w: Column) -> Column:
        grams = F.transform(w, lambda _, i: F.when(i + n <= F.size(w), F.array_join(F.slice(w, i + 1, n), " ")))
        return F.transform(F.filter(F.arrays_zip(w.alias("word"), T.repeats(grams, least).alias("again")), lambda x: ~x["again"]), lambda x: x["word"])

    return df.select(key, T.let(T.words(F.col(text)), kept).alias("w")).filter(F.size("w") > 0).select(key, F.array_join("w", " ").alias("text"))


def line_repetition(text: Column, least: int = 3) -> Column:
    """Repeats of lines that occur `least` times or more, as a share of all lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.stripped), lambda x: x != "")

    def share(a: Column) -> Column:
        again = F.size(F.filter(T.repeats(a, least), lambda r: r))
        return F.when(F.size(a) < least, 0.0).otherwise(F.least(F.lit(1.0), again / F.greatest(F.size(a), F.lit(1))))

    return T.let(lines, share)


#: Distinct chunks and characters of a document that are compared in one go, about. A document with more is cut to blocks.
BLOCK_CHUNKS, BLOCK_CHARS = 512, 1 << 20


def _shared(texts: list[list[str]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct n-grams of characters each chunk (a list of texts) has, and how many each two of them share."""
    flat = [t for ts in texts for t in ts]
    lens = np.array([len(t) for t in flat], np.int64)
    chunk = np.repeat(np.repeat(np.arange(len(texts)), [len(ts) for ts in texts]), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(lens.sum())  # characters up to the text's end
    at = np.flatnonzero(left >= n)
    if not len(at):
        return np.zeros(len(texts), np.int64), np.zeros((len(texts), len(texts)))
    char = np.unique(np.frombuffer("".join(flat).encode("utf-32-le"), np.uint32), return_inverse=True)[1]
    base = int(char.max()) + 1
    gram, top = char[at], base
    for j in range(1, n):
        if top * base >= 1 << 62:  # ranks stand for longer beginnings, so that equal numbers are equal n-grams
            gram = np.unique(gram, return_inverse=True)[1]
            top = int(gram.max()) + 1
        gram, top = gram * base + char[at + j], top * base
    both = np.unique(np.unique(gram, return_inverse=True)[1] * len(texts) + chunk[at])
    gram, chunk = both // len(texts), both % len(texts)
    sizes = np.bincount(chunk, minlength=len(texts))
    often = np.bincount(gram) > 1
    chunk, gram = chunk[often[gram]], (np.cumsum(often) - 1)[gram[often[gram]]]
    common, step = np.zeros((len(texts), len(texts))), 4096
    for lo in range(0, int(often.sum()), step):
        a, b = np.searchsorted(gram, [lo, lo + step])
        has = np.zeros((len(texts), min(step, int(often.sum()) - lo)), np.float32)
        has[chunk[a:b], gram[a:b] - lo] = 1
        common += has @ has.T
    return sizes, common


def _similarity(batches: Iterator[pa.RecordBatch], n: int = 5) -> Iterator[pa.RecordBatch]:
    """key and the Jaccard similarities, summed over the pairs of chunks in it, of each row (key, lo, hi, chunks): pairs of one block if lo = hi, else of both."""
    for b in batches:
        sums = []
        for lo, hi, chunks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            rows = chunks.as_py()
            sizes, common = _shared([r["t"] for r in rows], n)
            w = np.array([r["w"] for r in rows], float) * (sizes > 0)
            both = np.maximum(sizes[:, None] + sizes - common, 1)
            block = np.array([r["block"] for r in rows])
            pairs = np.triu(common / both * w[:, None] * w, 1)
            sums.append(float(pairs.sum() + (w * (w - 1) / 2).sum()) if lo == hi else float(pairs[block[:, None] != block].sum()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.float64())], [b.schema.names[0], "t"])


def duplicate_score(chunks: DataFrame, key: str, index: str = "chunk_index", text: str = "text") -> DataFrame:
    """key, n_chunks, pairs, overlap, repetition, score (0 to 100) of each document's chunks.

    The mean Jaccard similarity of distinct 5-grams of characters, over all pairs of a document's chunks. Its texts meet by one shuffle, equal ones as one with their number, and what
    pairs share is a product of matrices. The pairs of a document of many chunks are spread over tasks by blocks, so none of them holds more than two blocks. Rows that
    repeat an index are one chunk in pairs and count as often as they are there; those without a key or an index have nothing in common with others.
    """
    known = F.col(key).isNotNull() & F.col(index).isNotNull()
    each = chunks.groupBy(key, index).agg(F.collect_list(F.col(text)).alias("a"), F.count(F.lit(1)).alias("c"))  # one chunk's rows, which are seldom more than one
    each = each.withColumn("r", F.when(known, line_repetition(F.array_join("a", "\n"))).otherwise(0.0)).withColumn("a", F.sort_array(F.array_distinct(F.transform("a", lambda t: T.squeezed(F.lower(t))))))
    per = each.select(key, "c", F.when(known & F.exists("a", lambda t: F.length(t) >= 5), F.col("c")).otherwise(0).alias("k"), (F.col("r") * F.col("c")).alias("r"), F.lit(0.0).alias("t"))

    once = each.filter(known).groupBy(key, "a").agg(F.count(F.lit(1)).alias("w"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CHUNKS), F.ceil(F.sum(F.length(F.array_join("a", ""))) / BLOCK_CHARS)).cast("int")
    large = once.groupBy(key).agg(blocks.alias("blocks")).filter("blocks > 1")
    x = once.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.groupBy(key, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).agg(F.collect_list(F.struct("block", F.col("a").alias("t"), "w")).alias("chunks"))
    sums = arrow_map(x, _similarity, f"`{key}` {dict(x.dtypes)[key]}, t double")

    y = per.unionByName(sums.select(key, F.lit(0).cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("k"), F.lit(0.0).alias("r"), "t"))
    y = y.groupBy(key).agg(F.sum("c").alias("n_chunks"), F.sum("k").alias("k"), F.sum("r").alias("r"), F.sum("t").alias("t")).withColumn("repetition", F.col("r") / F.col("n_chunks"))
    y = y.withColumn("pairs", F.expr("k * (k - 1) div 2")).withColumn("overlap", F.when(F.col("pairs") > 0, F.col("t") / F.col("pairs")).otherwise(0.0))
    score = F.when(F.col("n_chunks") < 2, 100.0).otherwise(F.round(F.greatest(F.lit(0.0), (1 - (F.col("overlap") * 0.7 + F.col("repetition") * 0.3)) * 100), 2))
    return y.select(key, "n_chunks", "pairs", F.round("overlap", 6).alias("overlap"), F.round("repetition", 6).alias("repetition"), score.alias("score"))
