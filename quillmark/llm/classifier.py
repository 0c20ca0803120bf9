"""A quality classifier: regularised quadratic discriminant over transformed statistics of a text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, refuse, small, table, written

FEATURES = ("words", "word_len", "word_len_sd", "upper", "marks", "odd", "digits", "caps_words", "marked_words", "distinct", "same_next", "dup_lines", "line_len", "stops", "top_word", "shape")
ODD = "#*$%&|<>@^~{}[]\\_=+"
STOP = re.compile(r"[.!?](?=\s|$)")


def statistics(text: str) -> list[float]:
    """Sixteen statistics of one text, each on a scale where its spread is near even: logs of sizes, square roots of shares."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    k = len(words)
    lens = np.fromiter(map(len, words), np.float64, k)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZÉÈÊÇÀÄÖÜÑÓÍ"))
    odd = sum(map(text.count, ODD))
    marks = sum(map(text.count, ".,;:!?"))
    digits = sum(map(text.count, "0123456789"))
    caps = sum(w.isupper() and len(w) > 1 for w in words)
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:)\"'" for w in words)
    same = sum(map(str.__eq__, words, words[1:]))
    mean = n / len(lines)
    root = math.sqrt
    return [
        math.log1p(k), math.log(lens.mean()), math.log1p(lens.std()), root(upper / n), root(marks / n), root(odd / n), root(digits / n), root(caps / k), root(marked / k),
        root(1 - len(counts) / k), root(same / k), root(1 - len(set(lines)) / len(lines)), math.log(mean), root(len(STOP.findall(text)) / k), root(max(counts.values()) / k), root(text.count("\n") / n),
    ]


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of df, and x: array<double> of statistics(); a null text counts as ''. Row by row, no shuffle."""
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t or "") for t in b.column(len(keep)).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], x], [*keep, "x"])

    return arrow_map(df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("_q_text")), run, ", ".join([f"`{c}` {types[c]}" for c in keep] + ["x array<double>"]))


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of both classes, cached, and the constants of their log densities."""

    mean: list[np.ndarray]
    inverse: list[np.ndarray]
    constant: list[float]
    scale: float

    def score(self, x: str = "x") -> Column:
        """P(label 1) as a Column over an array: both squared Mahalanobis distances by forward substitution, kept in code that Spark compiles."""
        log = []
        for m, inv, c in zip(self.mean, self.inverse, self.constant, strict=True):
            centred = [F.col(x)[j] - F.lit(float(v)) for j, v in enumerate(m)]
            d2 = F.lit(0.0)
            for i in range(len(m)):
                z = F.lit(0.0)
                for j in range(i + 1):
                    z = z + F.lit(float(inv[i, j])) * centred[j]
                d2 = d2 + F.pow(z, F.lit(2.0))
            log.append(F.lit(c) - d2 / 2)
        margin = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), (log[1] - log[0]) * self.scale))
        return 1 / (1 + F.exp(-margin))


def moments(x: DataFrame, label: str = "label") -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of each class: rows, sums, sums of products. Added up in the tasks; two rows come to the driver, whatever the size of x."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    rows = x.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("s"), F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("p")
    ).filter(F.col(label).isin(0, 1)).collect()
    out = [(0, np.zeros(d), np.zeros((d, d)))] * 2
    for r in rows:
        p = np.zeros((d, d))
        for (i, j), v in zip(pairs, r.p, strict=True):
            p[i, j] = p[j, i] = v
        out[r[label]] = (r.n, np.array(r.s), p)
    return out


def fit(classes: list[tuple[int, np.ndarray, np.ndarray]], shrink: float = 0.15, ridge: float = 0.05, temper: float = 0.25) -> Discriminant:
    """Each class's covariance is drawn by `shrink` to the pooled one, which gets `ridge` of its mean variance on its diagonal.

    temper: the log-density difference is multiplied by it, as the statistics aren't independent normal draws and their raw
    difference is too sure of itself. A class without rows takes the pooled mean and covariance, so its documents
    are scored by the priors alone; with no rows at all every score is 0.5.
    """
    d = len(FEATURES)
    n = [c[0] for c in classes]
    every = sum(n)
    cov, mean = [], []
    total = (classes[0][1] + classes[1][1]) / max(every, 1)
    for k, s, p in classes:
        m = s / k if k else total
        mean.append(m)
        cov.append(p / k - np.outer(m, m) if k else np.zeros((d, d)))
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / max(every, 1)
    pooled = pooled + np.eye(d) * (ridge * np.trace(pooled) / d + 1e-6)
    inverse, constant = [], []
    for k, c in zip(n, cov, strict=True):
        w = 1.0 if not k else max(shrink, min(1.0, 2 * d / k))
        factor = np.linalg.cholesky((1 - w) * c + w * pooled + np.eye(d) * 1e-6)
        inverse.append(np.linalg.inv(factor))
        constant.append(float(math.log((k + 1) / (every + 2)) - np.log(np.diag(factor)).sum()))
    return Discriminant(mean, inverse, constant, temper)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7, label: str = "quality") -> DataFrame:
    """Of each row of df: id, held_out, score (P(label 1), 0 to 1), predicted (1 if score >= threshold).

    The model is fitted to all labelled rows that aren't held out, from sums that the tasks add up, so no sample is taken. Texts are read
    once: their statistics are written as a narrow table in the shared folder, which both the fit and the scores read.

    Nulls: a null text is scored like ''; a null id is scored and never learnt from; null labels and labels
    other than 0 and 1 are left out; of repeated labels for an id the smallest counts once. Repeated rows of df are each scored, and learnt as
    often as they occur. An empty table gives an empty result. Other columns of df have no effect. Sums of doubles are added in the order in which
    tasks end, so scores agree between runs to about nine digits.
    """
    x, classes = learnt(df, labels, [id_col], id_col, text, label)
    return x.withColumn("held_out", held_out(id_col)).withColumn("score", fit(classes).score()).select(id_col, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def learnt(df: DataFrame, labels: DataFrame, keep: list[str], id_col: str, text: str, label: str) -> tuple[DataFrame, list]:
    """Statistics of all rows of df with the columns `keep`, and the moments of both classes over the labelled rows that aren't held out."""
    x = written(with_statistics(df, keep, text), "statistics")
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.min(label).cast("int").alias("label"))
    return x, moments(x.join(known, id_col))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7, label: str = "quality") -> DataFrame:
    """The rows of df that the classifier doesn't reject, with df's columns. Each row is judged by its own text, whatever others have its id.

    Where there are no labelled rows of one of the classes nothing can be learnt, and all rows stay. Null texts are judged like '', null ids make no difference; equal rows stay
    or go alike. An empty table gives an empty result. A column of df named _q_t is refused.
    """
    refuse(df, "_q_t")
    keyed = df.withColumn("_q_t", F.xxhash64(id_col, text))
    x, classes = learnt(keyed, labels, [id_col, "_q_t"], id_col, text, label)
    if not all(n for n, _, _ in classes):
        return df
    bad = written(x.filter(fit(classes).score() < threshold).select("_q_t").distinct(), "rejected")
    return keyed.join(small(bad), "_q_t", "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of each document, learnt from the labels of the other folds."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
