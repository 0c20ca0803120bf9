"""State of files, stages, runs and evaluation sets, as tables to which rows are only added; the last row of a key counts."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def carry_forward(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Files of a new version that no upload came with: those of the source's current version, else of version 1, else of its newest.

    files: data_source_id, version, key, and more columns; requests: data_source_id, current, to, and prefix (of the new keys). Returns the files' columns with the new
    version and key, and from_version. Sources without files give no rows. One sum by source and two joins on it.
    """
    x = files.join(requests, "data_source_id")
    found = x.groupBy("data_source_id").agg(F.max(F.when(F.col("version") == F.coalesce("current", F.lit(1)), F.col("version"))).alias("a"), F.max(F.when(F.col("version") == 1, F.col("version"))).alias("b"), F.max("version").alias("c"))
    chosen = found.select("data_source_id", F.coalesce("a", "b", "c").alias("from_version"))
    moved = x.join(chosen, "data_source_id").filter(F.col("version") == F.col("from_version"))
    key = F.when(F.col("to") == F.col("from_version"), F.col("key")).otherwise(F.concat("prefix", F.element_at(F.split("key", "/"), -1)))
    return moved.select(*[key.alias("key") if c == "key" else F.col("to").alias("version") if c == "version" else F.col(c) for c in files.columns], "from_version")


def finished(files: DataFrame, failed: Column, message: Column) -> DataFrame:
    """files (status, error_message) once their run ended: what was PROCESSING is PROCESSED, or FAILED with the message; other states stay."""
    was = F.col("status") == "PROCESSING"
    return files.withColumn("error_message", F.when(was & failed, message).otherwise(F.col("error_message"))).withColumn("status", F.when(was & failed, "FAILED").when(was, "PROCESSED").otherwise(F.col("status")))


def stage_summary(results: DataFrame) -> DataFrame:
    """run_id, total_stages, completed_stages, completed (in the order in which they were) and any_failed, from results (run_id, stage, status, at).

    A stage is completed from its first success after its last failure on; a later failure takes it off the list again.
    """
    w = Window.partitionBy("run_id", "stage")
    x = results.withColumn("bad", F.max(F.when(F.col("status") == "failed", F.col("at"))).over(w))
    s = x.groupBy("run_id", "stage").agg(F.min(F.when((F.col("status") == "succeeded") & (F.col("bad").isNull() | (F.col("at") > F.col("bad"))), F.col("at"))).alias("done"), F.max_by("status", "at").alias("last"))
    done = F.transform(F.array_sort(F.collect_list(F.when(F.col("done").isNotNull(), F.struct("done", "stage")))), lambda v: v["stage"])  # a run's stages are few
    return s.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_stages"), F.count("done").alias("completed_stages"), done.alias("completed"), F.bool_or(F.col("last") == "failed").alias("any_failed"))


def numbered(requests: DataFrame, runs: DataFrame, limits: DataFrame) -> DataFrame:
    """Requests (request_id, workspace_id, product_id, at) with used (the workspace's runs in that month so far), allowed, and the number of those that are allowed.

    runs: workspace_id, product_id, version, started_at; limits: workspace_id, max_runs, where -1 and no row at all mean no limit. Requests are served in the order of at, so an earlier one uses
    the quota up for a later one; numbers go on from the product's largest.
    """
    month = lambda c: F.date_trunc("month", c)
    before = runs.groupBy("workspace_id", month("started_at").alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    x = requests.withColumn("_m", month("at")).join(before, ["workspace_id", "_m"], "left").join(limits, "workspace_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    turn = F.row_number().over(Window.partitionBy("workspace_id", "_m").orderBy("at", "request_id"))
    free = F.coalesce("max_runs", F.lit(-1)) == -1
    x = x.withColumn("allowed", free | (F.col("_n") + turn <= F.col("max_runs"))).withColumn("used", F.col("_n") + F.when(free, turn - 1).otherwise(F.least(turn - 1, F.greatest(F.lit(0), F.col("max_runs") - F.col("_n")))))
    last = runs.groupBy("product_id").agg(F.max("version").alias("_v"))
    order = Window.partitionBy("product_id").orderBy("at", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    number = F.coalesce("_v", F.lit(0)) + F.sum(F.col("allowed").cast("int")).over(order)
    return x.join(last, "product_id", "left").select("request_id", "workspace_id", "product_id", F.col("used").cast("bigint").alias("used"), "allowed", F.when(F.col("allowed"), number).cast("bigint").alias("version"))


class Log:
    """Rows by a key under one path. Each change is an added batch; `current` is the last row of each key that wasn't deleted. A batch without its success mark isn't read."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = f"{schema}, deleted boolean, seq bigint"

    def put(self, rows: DataFrame, deleted: bool = False) -> None:
        """Adds or replaces rows by key; of a key that occurs twice in a batch any row may stay."""
        at = time.time_ns()
        rows.withColumn("deleted", F.lit(deleted)).withColumn("seq", F.lit(at)).write.parquet(f"{self.path}/batch-{at:020d}-{uuid.uuid4().hex}")

    def delete(self, keys: list) -> None:
        self.put(self.current().filter(F.col(self.key).isin(keys)), deleted=True)

    def current(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        done = [s.getPath().getParent().toString() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-*/_SUCCESS")) or []]
        if not done:
            return self.spark.createDataFrame([], self.schema).drop("deleted", "seq")
        w = Window.partitionBy(self.key).orderBy(F.desc("seq"))
        return self.spark.read.schema(self.schema).parquet(*done).withColumn("_r", F.row_number().over(w)).filter("_r = 1 AND NOT deleted").drop("_r", "deleted", "seq")


class Datasets:
    """Evaluation sets (golden_qa, golden_retrieval, adversarial) and their items."""

    KINDS = ("golden_qa", "golden_retrieval", "adversarial")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.sets = Log(spark, f"{path}/sets", "dataset_id", "dataset_id string, product_id string, name string, kind string, status string")
        self.items = Log(spark, f"{path}/items", "item_id", "item_id string, dataset_id string, query string, expected_answer string, expected_chunks array<string>, question_type string")

    def create(self, product_id: str, name: str, kind: str) -> str:
        if kind not in self.KINDS:
            raise ValueError(f"no kind of set: {kind}")
        made = uuid.uuid4().hex
        self.sets.put(self.spark.createDataFrame([(made, product_id, name, kind, "active")], "dataset_id string, product_id string, name string, kind string, status string"))
        return made

    def add(self, dataset_id: str, items: DataFrame) -> None:
        """Items with query and, as the kind asks, expected_answer or expected_chunks; missing columns are null. Blank queries are left out."""
        have = {"expected_answer": "string", "expected_chunks": "array<string>", "question_type": "string"}
        x = items.filter(F.trim(F.coalesce("query", F.lit(""))) != "").withColumn("item_id", F.expr("uuid()") if "item_id" not in items.columns else F.col("item_id")).withColumn("dataset_id", F.lit(dataset_id))
        self.items.put(x.select("item_id", "dataset_id", "query", *[F.col(c).cast(t).alias(c) if c in items.columns else F.lit(None).cast(t).alias(c) for c, t in have.items()]))

    def update(self, dataset_id: str, **values: str) -> None:
        self.sets.put(self.sets.current().filter(F.col("dataset_id") == dataset_id).withColumns({k: F.lit(v) for k, v in values.items()}))

    def listed(self, product_id: str, kind: str | None = None) -> DataFrame:
        """Sets of a product with the number of their items."""
        x = self.sets.current().filter(F.col("product_id") == product_id)
        x = x.filter(F.col("kind") == kind) if kind else x
        return x.join(self.items.current().groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_items")), "dataset_id", "left").na.fill(0, ["n_items"])

    def remove(self, dataset_id: str) -> None:
        self.items.put(self.items.current().filter(F.col("dataset_id") == dataset_id), deleted=True)
        self.sets.delete([dataset_id])
