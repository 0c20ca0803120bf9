"""Vectors: similarity, exact search in blocks, quality figures, and a hash embedding for use without a model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def hash_embedding(text: Column, dims: int = 32) -> Column:
    """(byte - 128) / 128 of the text's SHA-256, repeated, with the length in the first place."""
    h = F.sha2(text, 256)
    rest = F.transform(F.sequence(F.lit(1), F.lit(dims - 1)), lambda i: (F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128) / 128)
    return F.concat(F.array(F.least(F.length(text) / 1000, F.lit(1.0))), rest)


def top_k(queries: DataFrame, vectors: DataFrame, k: int, by: str = "vec_id", vec: str = "embedding", least: float = -1.0, same: bool = False, block_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, id, score of the k nearest vectors of each query by cosine, ties (to twelve digits) by id.

    The stated queries are taken in blocks of at most block_bytes, as many as it needs; a block goes to every task that reads vectors. A task
    keeps the k best of each of its queries while batches of vectors pass, so memory and shuffle are k rows per query and task and no pair is
    ever a row. Null vectors and those of another length than the query's are no match; zero vectors have the cosine 0.
    """
    q = queries.select(F.col(by).alias("id"), F.transform(vec, lambda v: v.cast("double")).alias("v")).filter("v IS NOT NULL AND id IS NOT NULL")
    size = q.agg(F.sum(F.size("v") * 8 + 16).alias("b"), F.max(F.size("v") * 8 + 16).alias("most")).first()
    blocks = max(1, -(-(size.b or 0) // max(1, block_bytes - 4 * (size.most or 0))))
    v = vectors.select(F.col(by).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v")).filter("v IS NOT NULL AND id IS NOT NULL")
    schema = f"query_id {dict(q.dtypes)['id']}, id {dict(v.dtypes)['id']}, score double"
    out = None
    for b in range(blocks):
        part = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).collect()  # a block of bounded bytes
        found = v.mapInArrow(_search([(r.id, np.array(r.v)) for r in part], k, least, same), schema)
        out = found if out is None else out.unionByName(found)
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _search(block: list, k: int, least: float, same: bool):  # noqa: ANN202
    """The k best vectors of a task for each query of a block, by query length."""
    by_dim: dict[int, list] = {}
    for i, v in block:
        by_dim.setdefault(len(v), []).append((i, v / (np.linalg.norm(v) or 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        ids_of = {d: np.array([i for i, _ in qs], object) for d, qs in by_dim.items()}
        unit = {d: np.stack([v for _, v in qs]) for d, qs in by_dim.items()}
        for b in batches:
            dims = np.array(pc.list_value_length(b.column(1)))
            for d, u in unit.items():
                at = np.flatnonzero(dims == d)
                if not len(at) or not d:
                    continue
                ids = np.array(b.column(0).take(pa.array(at)).to_pylist(), object)
                x = b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                n = np.linalg.norm(x, axis=1)
                rows = best.setdefault(d, [(np.empty(0), np.empty(0, object))] * len(u))
                for lo in range(0, len(u), 256):  # 256 queries times a batch of vectors at once
                    scores = np.round(u[lo : lo + 256] @ (x / np.where(n > 0, n, 1.0)[:, None]).T, 12)
                    for j, s in enumerate(scores, lo):
                        s0, i0 = rows[j]
                        limit = s0[-1] if len(s0) == k else -np.inf
                        take = np.flatnonzero((s >= max(limit, least)) & (True if same else ids != ids_of[d][j]))
                        if len(take):
                            s1, i1 = np.concatenate([s0, s[take]]), np.concatenate([i0, ids[take]])
                            order = sorted(range(len(s1)), key=lambda r: (-s1[r], i1[r]))[:k] if len(s1) < 8 * k else sorted(np.flatnonzero(s1 >= np.partition(s1, -k)[-k]).tolist(), key=lambda r: (-s1[r], i1[r]))[:k]
                            rows[j] = s1[order], i1[order]
        kinds = [pa.array([i for i, _ in block[:1]] or [0]).type, b.schema.field(0).type if best else None, pa.float64()]
        for d, rows in best.items():
            for lo in range(0, len(rows), 1024):
                part = [(ids_of[d][j], i, s) for j, (ss, ii) in enumerate(rows[lo : lo + 1024], lo) for s, i in zip(ss, ii, strict=True)]
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in part], kinds[c]) for c in range(3)], ["query_id", "id", "score"])

    return run


def middle(x: DataFrame, value: str, margin: float = 0.0005) -> Column:
    """The exact median of a column, as a number: values are ranked only inside a narrow band around it, which an approximate percentile with a proven error gives."""
    lo, hi = x.agg(F.percentile_approx(value, [0.5 - margin, 0.5 + margin], 10_000).alias("p")).first().p or (None, None)
    if lo is None:
        return F.lit(None).cast("double")
    n, below = x.agg(F.count(value), F.count_if(F.col(value) < lo)).first()
    band = x.filter(F.col(value).between(lo, hi)).groupBy(value).agg(F.count(F.lit(1)).alias("n"))  # a thousandth of the values or so
    w = Window.orderBy(value)
    ranked = band.withColumn("to", F.sum("n").over(w) + below)
    a, b = (n - 1) // 2, n // 2
    got = ranked.agg(F.min(F.when(F.col("to") > a, F.col(value))).alias("a"), F.min(F.when(F.col("to") > b, F.col(value))).alias("b")).first()
    return F.lit((got.a + got.b) / 2)


def quality(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row: dimensions, finite and non-zero shares, norms, outliers beyond three deviations of the median, and the three scores."""
    x = vectors.select(F.size(vec).alias("dim"), F.exists(vec, lambda v: F.isnan(v) | v.isNull() | (F.abs(v) == float("inf"))).alias("bad"), norm(F.col(vec)).alias("norm"))
    common = x.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).select(F.col("dim").alias("usual"))
    ok = x.filter(~F.col("bad"))
    stats = ok.agg(F.stddev_pop("norm").alias("sd"), F.avg("norm").alias("mean")).withColumn("median", middle(ok, "norm"))
    g = (
        x.join(F.broadcast(common.join(stats, F.lit(True))), F.lit(True))  # one row
        .groupBy("usual", "median", "sd", "mean")
        .agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.col("dim") == F.col("usual")).alias("same_dim"), F.count_if("bad").alias("bad"), F.count_if(~F.col("bad") & (F.col("norm") > 0)).alias("non_zero"), F.count_if(~F.col("bad") & (F.abs(F.col("norm") - F.col("median")) > F.col("sd") * 3)).alias("outliers"))
    )
    n = F.col("vectors")
    vqs = (F.col("same_dim") * 0.4 + (n - F.col("bad")) * 0.3 + F.col("non_zero") * 0.3) / n
    return g.select(F.col("usual").alias("dim"), "vectors", "same_dim", "bad", "non_zero", "outliers", F.round("median", 6).alias("median_norm"), F.round("mean", 6).alias("mean_norm"), F.round("sd", 6).alias("sd_norm"), F.round(vqs, 6).alias("quality"))


def readiness(attempts: DataFrame, vec: str, expected_dim: int, fallback: str | None = None, requests: int = 0, errors: int = 0, fallback_mode: bool = False) -> DataFrame:
    """One row: per cent of dimensions that agree, of attempts that gave a vector, quality of vectors, health of the model, and readiness for semantic search.

    attempts: a row for each text that was to be embedded; vec is null or empty where no vector came, the boolean column fallback is true where a substitute was taken. requests and errors count calls of the model.
    Health of norms is one less the share of norms over three deviations from the median, 1 if there are fewer than two or all are equal; consistency falls with their coefficient of variation, to 0 at 0.75.
    A model that ran on fallback altogether has health 0. An empty table gives zeros but for the model's share that no attempt can lower.
    """
    v = F.col(vec)
    given = F.coalesce(F.size(v) > 0, F.lit(False))
    broken = F.exists(v, lambda e: F.isnan(e) | e.isNull() | (F.abs(e) == float("inf")))
    x = attempts.select(given.alias("given"), F.size(v).alias("dim"), (given & broken).alias("bad"), (given & F.exists(v, lambda e: e != 0)).alias("some"), F.when(given, norm(v)).alias("norm"), (F.coalesce(F.col(fallback), F.lit(False)) if fallback else F.lit(False)).alias("fb"))
    x = x.withColumn("norm", F.when(~F.col("bad") & (F.col("norm") > 0), F.col("norm")))
    stats = x.agg(F.stddev_pop("norm").alias("sd"), F.avg("norm").alias("mean")).withColumn("median", middle(x.filter("norm IS NOT NULL"), "norm"))
    far = F.abs(F.col("norm") - F.col("median")) > F.col("sd") * 3
    n = lambda c: F.count_if(c)
    g = x.join(F.broadcast(stats), F.lit(True)).agg(  # one row
        F.count(F.lit(1)).alias("attempted"), n(F.col("given")).alias("produced"), n(F.col("given") & (F.col("dim") != expected_dim)).alias("mismatched"), n(F.col("given") & ~F.col("bad")).alias("valid"),
        n(F.coalesce(F.col("some"), F.lit(False))).alias("non_zero"), n(F.col("fb")).alias("substitutes"), F.count("norm").alias("norms"), n(far).alias("outliers"), F.max("sd").alias("sd"), F.max("mean").alias("mean"),
    )
    share = lambda c, none=0.0: F.when(F.col("attempted") > 0, F.col(c) / F.col("attempted")).otherwise(F.lit(none))
    most = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))
    cents = lambda c: F.round(c + 1e-9, 2)
    steady = F.col("norms") > 1
    g = g.withColumn("norm_health", F.when(steady & (F.col("sd") > 0), 1 - F.col("outliers") / F.col("norms")).otherwise(F.lit(1.0)))
    g = g.withColumn("consistency", F.when(steady, 1 - F.least(F.lit(1.0), F.coalesce(F.col("sd") / F.nullif(F.col("mean"), F.lit(0.0)), F.lit(0.0)) / 0.75)).otherwise(F.lit(1.0)))
    g = g.withColumn("dims", F.when(F.col("attempted") > 0, 100 - share("mismatched") * 100).otherwise(F.lit(0.0))).withColumn("success", share("produced") * 100)
    g = g.withColumn("vqs", cents(most((share("valid") * 0.4 + share("non_zero") * 0.3 + F.col("norm_health") * 0.3) * 100)))
    calls = 1 - min(1.0, errors / requests if requests else 0.0)
    health = F.lit(0.3 * calls) + (1 - share("substitutes", float(fallback_mode))) * 0.25 + (1 - share("mismatched")) * 0.2 + F.col("norm_health") * 0.15 + F.col("consistency") * 0.1
    g = g.withColumn("health", F.lit(0.0) if fallback_mode else most(health * 100))
    ready = most(F.col("dims") * 0.25 + F.col("vqs") * 0.35 + F.col("health") * 0.25 + F.col("success") * 0.15)
    return g.select("attempted", "produced", "mismatched", "substitutes", "outliers", cents(F.col("dims")).alias("dimension_consistency"), cents(F.col("success")).alias("success_rate"), F.col("vqs").alias("vector_quality"), cents(F.col("health")).alias("model_health"), cents(ready).alias("semantic_readiness"))
