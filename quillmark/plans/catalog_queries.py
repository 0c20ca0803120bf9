"""Queries over runs, artifacts and users; orders, lineitem, customer and events stand for the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..session import table
from .registry import query


@query(
    """SELECT count(*) AS runs, round(avg((o_orderstatus = 'F')::INT), 6) AS success_rate, round(avg((epoch(o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 5)) - epoch(o_orderdate)) / 60), 4) AS minutes,
  greatest(0, 100 - 2 * count_if(o_totalprice > 400000))::BIGINT AS quality FROM orders"""
)
def platform_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, success rate, minutes and quality of the platform."""
    o = table(spark, sf_dir, "orders").withColumn("end", F.expr("o_orderdate + make_interval(0, 0, 0, 0, cast(o_orderkey % 5 as int), 0, 0)"))
    return C.platform(o, "o_orderstatus", "o_orderdate", "end", "F", F.col("o_totalprice") > 400000)


@query(
    """WITH b AS (SELECT max(o_orderdate) AS last FROM orders), m AS (SELECT unnest(generate_series((SELECT date_trunc('month', last) FROM b) - INTERVAL 5 MONTH, (SELECT date_trunc('month', last) FROM b) + INTERVAL 2 MONTH, INTERVAL 1 MONTH))::DATE AS month)
SELECT month, coalesce(count(o_orderkey), 0) AS runs, coalesce(count_if(o_orderstatus = 'F'), 0)::BIGINT AS ok, round(coalesce(sum(o_totalprice), 0), 2) AS amount FROM m LEFT JOIN orders ON date_trunc('month', o_orderdate)::DATE = month GROUP BY month"""
)
def monthly_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight months of runs, two of them with none."""
    o = table(spark, sf_dir, "orders")
    last = F.lit(o.agg(F.add_months(F.max("o_orderdate"), 2)).first()[0])  # one date
    x = C.monthly(o, "o_orderdate", last, 8, runs=F.count(F.lit(1)), ok=F.count_if(F.col("o_orderstatus") == "F"), amount=F.sum("o_totalprice"))
    return x.withColumn("amount", F.round("amount", 2))


@query(
    """SELECT CASE grouping_id(l_returnflag, l_linestatus, p) WHEN 3 THEN 'kind' WHEN 5 THEN 'stage' WHEN 6 THEN 'policy' ELSE 'all' END AS level, coalesce(l_returnflag, l_linestatus, p, 'all') AS value, count(*) AS n, round(sum(l_extendedprice), 2) AS bytes,
  round(sum(l_extendedprice) / 1073741824 * 0.023, 9) AS price FROM (SELECT *, 'p' || (l_linenumber % 3) AS p FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (p), ())"""
)
def artifact_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage by kind, stage and policy of artifacts, and in all."""
    x = table(spark, sf_dir, "lineitem").withColumn("p", F.concat(F.lit("p"), (F.col("l_linenumber") % 3).cast("string")))
    return C.costs(x, "l_returnflag", "l_linestatus", "p", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def largest_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest artifacts; the limit is the feature."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(10)


@query("SELECT l_linestatus AS stage, count(*) AS n, round(sum(l_quantity), 2) AS bytes, list_sort(list_distinct(list(l_returnflag))) AS kinds FROM lineitem GROUP BY l_linestatus")
def artifact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts by stage, with the kinds in each."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("bytes"), F.array_sort(F.collect_set("l_returnflag")).alias("kinds"))


@query(
    """WITH u AS (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS plan, count(o_orderkey) AS runs, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
l AS (SELECT *, CASE plan WHEN 'free' THEN 3 WHEN 'pro' THEN 25 ELSE -1 END AS runs_limit, CASE plan WHEN 'free' THEN 100 WHEN 'pro' THEN 2000 ELSE -1 END AS spent_limit FROM u)
SELECT *, runs_limit >= 0 AND runs > runs_limit AS runs_over, spent_limit >= 0 AND spent > spent_limit AS spent_over FROM l"""
)
def plan_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and spending of users against their plan."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    u = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(o, "c_custkey", "left").na.fill(0, ["runs", "spent"])
    plan = F.when(F.col("c_nationkey") % 3 == 0, "free").when(F.col("c_nationkey") % 3 == 1, "pro").otherwise("enterprise")
    return C.usage(u, plan, {"runs": F.col("runs"), "spent": F.col("spent")}).drop("c_nationkey")


@query("SELECT c_mktsegment, n_name, r_name, count(*) AS members, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def workspace_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by workspace along the hierarchy."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return x.groupBy("c_mktsegment", "n_name", "r_name").agg(F.count(F.lit(1)).alias("members"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer))")
def scoped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of products in one workspace, by a semi-join."""
    c = table(spark, sf_dir, "customer")
    first = c.agg(F.min("c_mktsegment").alias("c_mktsegment"))
    mine = c.join(first, "c_mktsegment", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(mine, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT count_if(event_type = 'click')::BIGINT AS clicks, count_if(value > 50)::BIGINT AS high, count_if(user_id IS NOT NULL)::BIGINT AS known FROM events")
def lineage_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three filtered counts of one table in one pass."""
    return table(spark, sf_dir, "events").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("user_id").isNotNull()).alias("known"))


@query("SELECT event_type, count(*) AS total, count_if(value >= 50)::BIGINT AS active, count(DISTINCT user_id) AS users FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY GROUP BY event_type")
def compliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and all rules of a period by kind."""
    e = table(spark, sf_dir, "events")
    start = e.agg(F.min("ts")).first()[0]  # one time
    x = e.filter(F.col("ts") >= F.lit(start) + F.expr("INTERVAL 1 DAY"))
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") >= 50).alias("active"), F.countDistinct("user_id").alias("users"))


@query("SELECT o_custkey, max(o_orderkey) AS latest, max(o_orderkey) + 1 AS next, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY o_custkey")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest and the next version of each product, and its distinct states."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest"), (F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next"), F.countDistinct("o_orderstatus").alias("states"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run of each product."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return C.latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def run_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty finished runs, with their number in all."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return C.page(o, [F.desc("o_orderdate"), F.asc("o_orderkey")], 2, 20)


@query(
    """WITH RECURSIVE e AS (SELECT o_orderkey AS child, o_orderkey // 2 AS parent FROM orders UNION ALL SELECT o_orderkey, o_orderkey - 3 FROM orders WHERE o_orderkey % 5 = 0),
w AS (SELECT 1::BIGINT AS root, 1::BIGINT AS node, 0 AS depth UNION ALL SELECT root, child, depth + 1 FROM w JOIN e ON e.parent = w.node WHERE depth < 5)
SELECT root, node, min(depth)::INTEGER AS depth FROM w GROUP BY root, node"""
)
def lineage_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was made from an artifact within five steps, at the least distance."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    e = o.select(k.alias("child"), F.expr("o_orderkey div 2").alias("parent")).unionByName(o.filter(k % 5 == 0).select(k.alias("child"), (k - 3).alias("parent")))
    return C.lineage(e, spark.createDataFrame([(1,)], "root bigint"), 5)


@query(
    """SELECT o_orderkey, CASE WHEN st = 'DELETED' AND datediff('day', del::DATE, DATE '1998-08-02') > 7 THEN 'PURGED' WHEN st = 'ACTIVE' AND days IS NOT NULL AND datediff('day', o_orderdate::DATE, DATE '1998-08-02') > days AND (pol <> 'delete_after_90_days_if_failed' OR o_orderstatus = 'F') THEN 'DELETED' ELSE st END AS next_status
FROM (SELECT *, o_orderdate + INTERVAL 20 DAY AS del, CASE o_orderkey % 7 WHEN 0 THEN 'DELETED' ELSE 'ACTIVE' END AS st, CASE o_custkey % 5 WHEN 0 THEN 'delete_after_30_days' WHEN 1 THEN 'delete_after_90_days' WHEN 2 THEN 'delete_after_365_days' WHEN 3 THEN 'delete_after_90_days_if_failed' ELSE 'keep_forever' END AS pol,
  CASE o_custkey % 5 WHEN 0 THEN 30 WHEN 1 THEN 90 WHEN 2 THEN 365 WHEN 3 THEN 90 END AS days FROM orders)"""
)
def retention_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the retention job makes of each artifact on a date."""
    policies = F.array(*map(F.lit, (*C.RETENTION_DAYS, "keep_forever")))
    o = table(spark, sf_dir, "orders").withColumn("pol", F.element_at(policies, (F.col("o_custkey") % 5 + 1).cast("int")))
    o = o.withColumn("st", F.when(F.col("o_orderkey") % 7 == 0, "DELETED").otherwise("ACTIVE")).withColumn("del", F.col("o_orderdate") + F.expr("INTERVAL 20 DAYS"))
    return C.retention(o, "pol", "st", "o_orderdate", "del", F.col("o_orderstatus") == "F", F.lit("1998-08-02")).select("o_orderkey", "next_status")


@query("SELECT l_linestatus, l_returnflag, l_quantity, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of artifacts that look alike, which a cleanup would recommend to thin out."""
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query(
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_first' WHEN a.k IS NULL THEN 'only_second' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k"""
)
def run_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of two runs: in the first, the second, or both."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("o"))
    return C.run_diff(x.filter("o % 2 = 0"), x.filter("o % 2 = 1"), "k")


@query("SELECT a.o_orderkey, b.o_orderkey AS other, round(b.o_totalprice - a.o_totalprice, 2) AS size_diff, datediff('day', a.o_orderdate::DATE, b.o_orderdate::DATE)::INTEGER AS days FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def artifact_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and ages of artifacts against the next one's."""
    o = table(spark, sf_dir, "orders")
    a = o.select(F.col("o_orderkey"), F.col("o_totalprice").alias("p"), F.col("o_orderdate").alias("d"))
    b = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderkey").alias("other"), F.col("o_totalprice").alias("q"), F.col("o_orderdate").alias("e"))
    return a.join(b, "o_orderkey").select("o_orderkey", "other", F.round(F.col("q") - F.col("p"), 2).alias("size_diff"), F.datediff("e", "d").alias("days"))


@query("SELECT o_custkey, o_orderkey, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, lead(o_orderdate) OVER w IS NULL AS is_current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def rule_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of rules with the time each was valid."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("_at", F.struct("o_orderdate", "o_orderkey"))
    h = C.history(o, ["o_custkey"], "_at")
    return h.select("o_custkey", "o_orderkey", F.col("valid_from.o_orderdate").alias("valid_from"), F.col("valid_to.o_orderdate").alias("valid_to"), "is_current")


@query("SELECT user_id, count(*) AS requests, sum(('0' || regexp_extract(props, '\"k\": *(\\d+)', 1))::BIGINT)::BIGINT AS k, md5(string_agg(event_type, ',' ORDER BY ts, event_id)) AS prompt_hash FROM events GROUP BY user_id")
def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log by user: number, a number out of the JSON payload, and a hash of what was asked in order."""
    e = table(spark, sf_dir, "events").withColumn("k", F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)))
    g = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("k").alias("k"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("a"))
    return g.select("user_id", "requests", "k", F.md5(F.array_join(F.transform("a", lambda s: s["event_type"]), ",")).alias("prompt_hash"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows over events, the batch form of the stream."""
    from ..streaming.events import windowed

    return windowed(table(spark, sf_dir, "events")).select("hour", "event_type", "n", F.round("value", 4).alias("value"))


@query("SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, count(*) AS pages, round(avg(length(html)), 4) AS avg_size, count(DISTINCT md5(html)) AS distinct_pages FROM pages GROUP BY host")
def web_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host, with checksums."""
    x = table(spark, sf_dir, "pages").withColumn("host", F.expr("parse_url(url, 'HOST')"))
    return x.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg(F.length("html")), 4).alias("avg_size"), F.countDistinct(F.md5("html")).alias("distinct_pages"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of all objects."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("SELECT doc_id, text FROM (SELECT d.doc_id, d.text, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id DESC) AS r FROM documents d) WHERE r = 1")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written under one key, the last write kept; the source stands for the key."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return C.latest(d, ["source"], [F.desc("doc_id")]).select("doc_id", "text")
