"""Collections of vectors as tables merged when read: names, aliases, upserts, pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge import MergeTable


def sanitized(name: str) -> str:
    """Lower case, other signs as single underscores, none at the ends."""
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", name.lower())).strip("_")


def collection(workspace: str, name: str, version: int) -> str:
    return f"ws_{sanitized(workspace)}__{sanitized(name)}__v_{version}"


def alias(workspace: str, name: str) -> str:
    return f"prod_ws_{sanitized(workspace)}__{sanitized(name)}"


class Collections:
    """Vector tables under one path: a folder per collection, and a small table of aliases. A point is (point_id, embedding, payload columns)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, p: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        x = jvm.org.apache.hadoop.fs.Path(p)
        return x, x.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        x, fs = self._fs(self.path)
        return sorted(s.getPath().getName() for s in fs.listStatus(x) if s.isDirectory() and s.getPath().getName().startswith("ws_") and self.of(s.getPath().getName()).versions()) if fs.exists(x) else []

    def of(self, name: str) -> MergeTable:
        """The table behind a collection: its versions, compaction and vacuum."""
        return MergeTable(self.spark, f"{self.path}/{name}", "point_id", self.buckets)

    def points(self, name: str, version: int | None = None) -> DataFrame:
        return self.of(name).read(version)

    def ensure(self, name: str, dim: int) -> None:
        """Drops a collection whose vectors have other dimensions; the next upsert makes it anew."""
        if name in self.names():
            first = self.points(name).select(F.size("embedding").alias("d")).first()
            if first and first.d != dim:
                self.drop(name)

    def drop(self, name: str) -> None:
        x, fs = self._fs(f"{self.path}/{name}")
        fs.delete(x, True)

    def upsert(self, name: str, points: DataFrame, order: str | None = None) -> int:
        """Last write wins by point_id. Only the batch is written; a crash leaves the version before."""
        return self.of(name).upsert(points, order)

    def remove(self, name: str, ids: DataFrame) -> int | None:
        """Takes the points of a table of point_id out."""
        return self.of(name).delete(ids)

    def info(self, name: str) -> dict:
        r = self.points(name).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
        return {"name": name, "points": r.n, "dim": r.d}

    def scroll(self, name: str, after: str | None = None, limit: int = 100, where: str | None = None) -> DataFrame:
        """A page of points behind an id, in order of ids."""
        x = self.points(name)
        x = x.filter(F.col("point_id") > after) if after is not None else x
        return (x.filter(where) if where else x).orderBy("point_id").limit(limit)

    def by_chunk(self, name: str, chunk_id: str) -> DataFrame:
        return self.points(name).filter(F.col("chunk_id") == chunk_id).limit(1)

    def set_alias(self, name: str, to: str) -> None:
        """Points an alias at a collection: a row of a table to which rows are only added; the last one counts."""
        if to not in self.names():
            raise ValueError(f"no collection {to}")
        self.spark.createDataFrame([(name, to)], "alias string, collection string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/aliases")

    def resolve(self, name: str) -> str | None:
        x, fs = self._fs(f"{self.path}/aliases")
        if not fs.exists(x):
            return None
        r = self.spark.read.parquet(f"{self.path}/aliases").filter(F.col("alias") == name).orderBy(F.desc("at")).first()
        return r.collection if r else None
