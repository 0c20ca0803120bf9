"""An approximate index of vectors: cells around centroids, product codes inside them, and a re-rank by true cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vectors import cosine, top_k

#: Vectors that centroids and codes are fitted on, at most; all vectors are indexed.
SAMPLE = 20_000
#: Cells at most, so that centroids are a bounded broadcast.
CELLS = 1024
#: Vectors of a cell that one task looks at, about.
PIECE = 50_000


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def _means(x: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """n centres of x by Lloyd's rounds; a centre without points stays."""
    c = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n_of = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n_of > 0] = sums[n_of > 0] / n_of[n_of > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, axis=1)


def _rows(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)


def _usable(df: DataFrame, by: str, vec: str, dim: int) -> DataFrame:
    x = df.select(F.col(by).alias("id"), F.transform(vec, lambda v: v.cast("double")).alias("v"))
    return x.filter((F.size("v") == dim) & F.col("id").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e)))


def build(vectors: DataFrame, path: str, dim: int, by: str = "vec_id", vec: str = "embedding", cells: int | None = None, parts: int = 16, codes: int = 64, sample: int = SAMPLE, seed: int = 7) -> None:
    """Writes an index of all vectors to path: `cells` (id, code, v; a folder for each cell), `centroids` and `books`.

    Centroids, the square root of the vectors at most, and the words of each of `parts` stretches of a vector's difference from its centroid are fitted on `sample`
    unit vectors, those with the least hashes of their ids. Then every vector is put in the cell of its nearest centroid, with a byte for each stretch. Nothing but the sample reaches
    the driver. Vectors that are null, of another length, or not numbers can match nothing and are left out; zero vectors are indexed and have the cosine 0. Repeated ids are
    indexed each. Without usable vectors the index is empty and finds nothing.
    """
    spark, x = vectors.sparkSession, _usable(vectors, by, vec, dim)
    n = x.count()
    got = [r.v for r in x.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()]
    known = _unit(np.array(got, float).reshape(-1, dim)) if got else np.zeros((1, dim))
    c = _means(known, cells or max(1, min(CELLS, math.isqrt(n))), 8, seed)
    rest = known - c[_nearest(known, c)]
    cuts = np.array_split(np.arange(dim), min(parts, dim))
    books = [_means(rest[:, at], min(codes, 256), 8, seed + i) for i, at in enumerate(cuts)]
    model = spark.sparkContext.broadcast((c, cuts, books))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, at_of, words = model.value
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(_rows(b.column(1), dim))
            cell = _nearest(u, centres)
            d = u - centres[cell]
            code = np.stack([_nearest(d[:, at], w) for at, w in zip(at_of, words, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in code], pa.binary()), b.column(1)], ["id", "cell", "code", "v"])

    made = x.mapInArrow(assign, f"id {dict(x.dtypes)['id']}, cell int, code binary, v array<double>")
    made.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // PIECE // len(c) + 1)))).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, v array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(books)], "part int, words array<array<double>>").write.mode("overwrite").parquet(f"{path}/books")


def _aimed(q: DataFrame, model, probes: int) -> DataFrame:  # noqa: ANN001
    """query_id, q, cell, place: the `probes` cells nearest to each query (id, v), the nearest at place 1."""

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = model.value[0]
        dim = centres.shape[1]
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(_rows(b.column(1), dim))
            near = np.argsort((centres * centres).sum(1)[None] - 2 * u @ centres.T, axis=1, kind="stable")[:, :probes]
            rows = pa.array(np.repeat(np.arange(len(u)), near.shape[1]))
            place = np.tile(np.arange(1, near.shape[1] + 1), len(u))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(near.ravel(), pa.int32()), pa.array(place, pa.int32())], ["query_id", "q", "cell", "place"])

    return q.mapInArrow(aim, f"query_id {dict(q.dtypes)['id']}, q array<double>, cell int, place int")


def _model(spark: SparkSession, path: str):  # noqa: ANN202
    """Centroids (CELLS rows at most), the places of each stretch, and the words of each stretch, broadcast."""
    c = np.array([r.v for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])
    books = [np.array(r.words) for r in spark.read.parquet(f"{path}/books").orderBy("part").collect()]
    return spark.sparkContext.broadcast((c, np.array_split(np.arange(c.shape[1]), len(books)), books))


def probes_for(spark: SparkSession, path: str, queries: DataFrame, k: int, by: str = "vec_id", vec: str = "embedding", share: float = 0.97, sample: int = 64) -> int:
    """The least number of probes with which `share` of the true k nearest of `sample` queries (those with the least hashes of their ids) lie in probed cells.

    The true ones come from the exact search over all indexed vectors; each one's cell has a place in its query's order of cells, and those places are counted. Without queries or vectors it is 1."""
    model = _model(spark, path)
    dim = model.value[0].shape[1]
    some = _usable(queries, by, vec, dim).orderBy(F.xxhash64("id"), "id").limit(sample)
    cells = spark.read.parquet(f"{path}/cells") if not some.isEmpty() else None
    if cells is None:
        return 1
    truth = top_k(some, cells.select("id", "v"), k, "id", "v").select("query_id", "id")
    places = truth.join(cells.select("id", "cell"), "id").join(_aimed(some, model, len(model.value[0])).select("query_id", "cell", "place"), ["query_id", "cell"])
    rows = sorted((r.place, r["count"]) for r in places.groupBy("place").count().collect())  # CELLS rows at most
    total, seen = sum(n for _, n in rows), 0
    for place, n in rows:
        seen += n
        if seen >= share * total:
            return place
    return 1


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, by: str = "vec_id", vec: str = "embedding", probes: int = 16, short: int | None = None, same: bool = False) -> DataFrame:
    """query_id, rank, id, score of the k nearest indexed vectors of each query, as `vectors.top_k` gives them, found in the `probes` cells nearest to each query.

    Queries stay a table: each goes to its cells, a cell's codes and the queries that look at it meet in one task (large cells in several, by hash of the id), and the
    `short` best by codes for each query are joined with their vectors and ranked by true cosine. Only folders of probed cells are read. As many probes as cells and a `short` of all rows make it exact.
    Queries that are null or of another length find nothing; equal scores (to twelve digits) are in order of the id.
    """
    model = _model(spark, path)
    dim, short = model.value[0].shape[1], short or 10 * k
    q = _usable(queries, by, vec, dim)
    kind = dict(q.dtypes)["id"]

    aimed = _aimed(q, model, probes).drop("place")
    cells = spark.read.schema(f"id {kind}, code binary, v array<double>, cell int").parquet(f"{path}/cells")
    probed = [r.cell for r in aimed.select("cell").distinct().collect()]  # CELLS numbers at most
    cells = cells.filter(F.col("cell").isin(probed))
    sizes = F.broadcast(cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces")))  # CELLS rows at most
    left = cells.select("id", "code", "cell").join(sizes, "cell").withColumn("piece", F.expr("cast(pmod(xxhash64(id), pieces) as int)")).drop("pieces")
    right = aimed.join(sizes, "cell").select("query_id", "q", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))

    def look(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        centres, at_of, words = model.value
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": [], "id": [], "near": []})
        code = np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1)
        ids, out = x["id"].to_numpy(), []
        for i, v in zip(y["query_id"], y["q"], strict=True):
            u = _unit(np.array(v, float)[None])[0]
            score = np.full(len(x), u @ centres[key[0]])
            for j, (at, w) in enumerate(zip(at_of, words, strict=True)):
                score += (w @ u[at])[code[:, j]]
            best = np.argsort(-score, kind="stable")[: short + 1]
            out.append(pd.DataFrame({"query_id": i, "id": ids[best], "near": score[best]}))
        return pd.concat(out)

    found = left.groupBy("cell", "piece").cogroup(right.groupBy("cell", "piece")).applyInPandas(look, f"query_id {kind}, id {kind}, near double")
    found = found if same else found.filter("query_id <> id")
    first = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    found = found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= short).select("query_id", "id").distinct()
    exact = found.join(cells.select("id", "v"), "id").join(q.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    exact = exact.select("query_id", "id", F.round(cosine(F.col("q"), F.col("v")), 12).alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return exact.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
