"""Analytics over runs, artifacts and other catalogue tables; every loop over months, products or artifacts is one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed price of a gigabyte and month, and days that artifacts stay by policy.
PRICE_GB = 0.023
RETENTION_DAYS = {"delete_after_30_days": 30, "delete_after_90_days": 90, "delete_after_365_days": 365, "delete_after_90_days_if_failed": 90}
PURGE_DAYS = 7
#: Fixed monthly limits by plan; -1 is no limit.
PLANS = {"free": (3, 100), "pro": (25, 2000), "enterprise": (-1, -1)}


def platform(runs: DataFrame, status: str, started: str, ended: str, ok: str, violations: Column) -> DataFrame:
    """One row: runs, success rate, mean minutes, quality of 100 less twice the violations."""
    minutes = (F.unix_timestamp(ended) - F.unix_timestamp(started)) / 60
    v = F.sum(violations.cast("long"))
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg((F.col(status) == ok).cast("double")), 6).alias("success_rate"), F.round(F.avg(minutes), 4).alias("minutes"), F.greatest(F.lit(0), 100 - v * 2).alias("quality"))


def monthly(facts: DataFrame, at: str, last: Column, months: int = 6, **sums: Column) -> DataFrame:
    """A row for each of the last months up to `last`, zeros where nothing happened: a sequence of months joined to one grouped pass."""
    spark = facts.sparkSession
    month = F.date_trunc("month", F.col(at))
    g = facts.filter((F.col(at) >= F.add_months(F.date_trunc("month", last), -(months - 1))) & (month <= F.date_trunc("month", last))).groupBy(month.cast("date").alias("month")).agg(*[c.alias(k) for k, c in sums.items()])
    start = F.add_months(F.trunc(last.cast("date"), "month"), -(months - 1))
    calendar = spark.range(1).select(F.explode(F.sequence(start, F.trunc(last.cast("date"), "month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return calendar.join(g, "month", "left").na.fill(0)


def costs(artifacts: DataFrame, kind: str, stage: str, policy: str, size: str) -> DataFrame:
    """Count, bytes and monthly price by kind, by stage, by policy and in all, in one pass."""
    sets = artifacts.groupingSets([[F.col(kind)], [F.col(stage)], [F.col(policy)], []], F.col(kind), F.col(stage), F.col(policy))
    x = sets.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.grouping_id().alias("g"))
    return x.select(
        F.when(F.col("g") == 3, "kind").when(F.col("g") == 5, "stage").when(F.col("g") == 6, "policy").otherwise("all").alias("level"),
        F.coalesce(kind, stage, policy, F.lit("all")).alias("value"), "n", F.round("bytes", 2).alias("bytes"), F.round(F.col("bytes") / (1 << 30) * PRICE_GB, 9).alias("price"),
    )


def usage(users: DataFrame, plan: Column, used: dict[str, Column]) -> DataFrame:
    """users with the limit of each kind of use and whether it is exceeded; `used` are two columns, for the plan's two limits."""
    out = users.withColumn("plan", plan)
    for i, (k, c) in enumerate(used.items()):
        limit = F.element_at(F.create_map(*[x for p, v in PLANS.items() for x in (F.lit(p), F.lit(v[i]))]), F.col("plan"))
        out = out.withColumn(f"{k}_limit", limit).withColumn(f"{k}_over", (F.col(f"{k}_limit") >= 0) & (c > F.col(f"{k}_limit")))
    return out


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; ties go by the order's later columns."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of rows in a total order, with the number of all rows beside it."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(number * size).limit(size).join(total, F.lit(True))


def edges(artifacts: DataFrame, id_col: str = "id", inputs: str = "input_ids") -> DataFrame:
    """parent, child of artifacts and what they were made from."""
    return artifacts.select(F.explode(inputs).alias("parent"), F.col(id_col).alias("child"))


def lineage(e: DataFrame, roots: DataFrame, depth: int = 5, down: bool = True) -> DataFrame:
    """root, node, depth: all nodes within `depth` steps of the roots, at their least distance. Each step joins distinct nodes only, and there are `depth` of them, so cycles end."""
    a, b = ("parent", "child") if down else ("child", "parent")
    step = e.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    front = roots.select(F.col("root"), F.col("root").alias("node"))
    seen = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = front.join(step, "node").select("root", F.col("next").alias("node")).distinct()
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def retention(artifacts: DataFrame, policy: str, status: str, created: str, deleted: str, failed: Column, as_of: Column) -> DataFrame:
    """artifacts with next_status: expired ones are DELETED, those deleted over a week ago PURGED, those to be kept stay."""
    days = F.lit(None).cast("int")
    for p, n in RETENTION_DAYS.items():
        days = F.when(F.col(policy) == p, F.lit(n)).otherwise(days)
    age = F.datediff(as_of.cast("date"), F.col(created).cast("date"))
    due = days.isNotNull() & (age > days) & ((F.col(policy) != "delete_after_90_days_if_failed") | failed)
    purge = (F.col(status) == "DELETED") & (F.datediff(as_of.cast("date"), F.col(deleted).cast("date")) > PURGE_DAYS)
    return artifacts.withColumn("next_status", F.when(purge, "PURGED").when((F.col(status) == "ACTIVE") & due, "DELETED").otherwise(F.col(status)))


def run_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: only_first, only_second or both."""
    x = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer")
    return x.select(key, F.when(F.col("b").isNull(), "only_first").when(F.col("a").isNull(), "only_second").otherwise("both").alias("side"))


def history(changes: DataFrame, key: list[str], at: str) -> DataFrame:
    """changes with valid_from, valid_to and is_current: versions of slowly changing rows."""
    w = Window.partitionBy(*key).orderBy(at)
    return changes.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(w)).withColumn("is_current", F.lead(at).over(w).isNull())


def archive(rows: DataFrame, at: str, as_of: Column, days: int, path: str, by: list[str]) -> DataFrame:
    """Writes rows older than so many days under path by their keys, and returns the rows that stay. A second run over what stays writes nothing more."""
    old = F.datediff(as_of.cast("date"), F.col(at).cast("date")) > days
    rows.filter(old).write.mode("append").partitionBy(*by).parquet(path)
    return rows.filter(~F.coalesce(old, F.lit(False)))


def registered(artifacts: DataFrame, inputs: DataFrame, failed: DataFrame, held: tuple[str, ...] = ("artifact_id", "stage", "name", "key")) -> DataFrame:
    """Artifacts (artifact_id, run_id, stage, name, key, policy) as they are put on record: with status ACTIVE, the inputs that are known as structs of the columns `held` in
    order of their ids, and policy delete_after_90_days_if_failed for delete_after_90_days in runs that failed.

    inputs: artifact_id, input_id; failed: run_id. Unknown and repeated inputs are left out. Inputs are dealt once by input_id and once, as flat rows, by artifact_id; of runs only ids are
    shuffled. Artifacts that are dealt by artifact_id already aren't shuffled again.
    """
    runs = failed.select("run_id").distinct()
    x = artifacts.filter("artifact_id IS NOT NULL")
    known = x.select(F.col("artifact_id").alias("input_id"), F.struct(*held).alias("i"))
    found = inputs.filter("artifact_id IS NOT NULL").join(known.hint("merge"), "input_id").select("artifact_id", "i")  # by sizes of files alone Spark may take millions of rows for few and broadcast them
    found = found.repartition("artifact_id").groupBy("artifact_id").agg(F.array_sort(F.collect_set("i")).alias("inputs"))  # an artifact's inputs are few
    due = x.filter(F.col("policy") == "delete_after_90_days").select("artifact_id", "run_id").join(runs, "run_id", "left_semi")
    due = due.repartition("artifact_id").groupBy("artifact_id").agg(F.collect_set("run_id").alias("_f"))
    out = x.join(due.hint("merge"), "artifact_id", "left").join(found.hint("merge"), "artifact_id", "left").withColumn("_f", F.array_contains("_f", F.col("run_id")))
    bare = artifacts.filter("artifact_id IS NULL").join(runs.withColumn("_f", F.lit(True)), "run_id", "left").withColumn("inputs", F.lit(None).cast(found.schema["inputs"].dataType))
    policy = F.when((F.col("policy") == "delete_after_90_days") & F.col("_f"), "delete_after_90_days_if_failed").otherwise(F.col("policy"))
    return out.unionByName(bare).withColumn("policy", policy).withColumn("inputs", F.coalesce("inputs", F.array().cast(found.schema["inputs"].dataType))).withColumn("status", F.lit("ACTIVE")).drop("_f")
