"""Hooks for models: any function of texts can embed, rank again, or measure coherence; without one there is a plain fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as S
from ..functions import text as T
from .vectors import hash_embedding

#: A model of embeddings: texts to an array of vectors, one a row. It is sent to the tasks, so it should load its weights when first called.
Embed = Callable[[list[str]], np.ndarray]
#: A model that scores pairs of a query and a text.
Score = Callable[[list[str], list[str]], np.ndarray]


def embedding(text: Column, model: Embed | None = None, dims: int = 32, batch: int = 256) -> Column:
    """The vector of a text, by the model in batches, or the hash embedding without one. A null text counts as ''."""
    if model is None:
        return hash_embedding(F.coalesce(text, F.lit("")), dims)

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in np.asarray(model(texts[i : i + batch]), float).tolist()], dtype=object)

    return run(text)


def rerank(hits: DataFrame, by: list[str], query: str, text: str, order: list[str], model: Score | None = None, k: int | None = None, batch: int = 32) -> DataFrame:
    """hits with rerank_score and place (from 1) in each `by` group: by the model's score of (query, text), then by `order`, columns where the greatest is best.

    Without a model all scores are 0 and the order stays. With k only the first k stay. A text or query that is null counts as ''.
    """
    if model is None:
        scored = hits.withColumn("rerank_score", F.lit(0.0))
    else:

        @F.pandas_udf("double")
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, t in parts:
                a, b = q.fillna("").tolist(), t.fillna("").tolist()
                yield pd.Series([float(x) for i in range(0, len(a), batch) for x in model(a[i : i + batch], b[i : i + batch])])

        scored = hits.withColumn("rerank_score", run(F.col(query), F.col(text)))
    w = Window.partitionBy(*by).orderBy(F.desc("rerank_score"), *[F.desc(c) for c in order])
    out = scored.withColumn("place", F.row_number().over(w))
    return out if k is None else out.filter(F.col("place") <= k)


def coherence(text: Column, model: Embed | None = None, window: int = 3, threshold: float = 0.6) -> Column:
    """0 to 1: how near each sentence is to those in front of it, as the mean cosine over a window that is at most 3 in texts of over 20 sentences and 5 in those of over 10.

    A threshold under 0.6 marks formal texts, whose cosines of 0.3 and 0.6 count as 0.5 and 1. Texts under 50 characters give 0, single sentences 1. Without a model
    it is the overlap of neighbouring sentences' words.
    """
    if model is None:
        return S.connectivity(text)
    cut = F.filter(F.transform(F.split(text, r"[.!?]+(?=\s+[A-Z0-9\"'(\[{]|$)"), T.stripped), lambda s: s != "")

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([window_coherence(np.asarray(model(list(x)), float), window, threshold) if len(x) > 1 else 1.0 for x in s])

    return F.when(F.length(T.stripped(text)) < 50, 0.0).otherwise(run(cut))


def window_coherence(vectors: np.ndarray, window: int, threshold: float) -> float:
    """The same for the vectors of one text's sentences."""
    n = len(vectors)
    width = min(window, 3) if n > 20 else min(window, 5) if n > 10 else window
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms == 0, 1, norms)
    mean = float(np.mean([(unit[max(0, i - width) : i] @ unit[i]).mean() for i in range(1, n)]))
    if threshold >= 0.6:
        return max(0.0, min(1.0, mean))
    return max(0.0, mean / 0.3 * 0.5 if mean < 0.3 else 0.5 + (mean - 0.3) / 0.3 * 0.5 if mean <= 0.6 else min(1.0, mean))
