"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import key60, refuse, rejoin, row_hash, running, stratum, table, written

SEED = "shard-1"


def interleave(df: DataFrame, n_shards: int = 8, by: str = "source", id_col: str = "doc_id", seed: str = SEED) -> DataFrame:
    """Adds shard (0 to n_shards - 1) and slot (from 0, gapless in its shard) to every row of df.

    Rows are shuffled by a seeded MD5 of the id and ranked inside their stratum; rank r of n gets the fraction
    (2r + 1) / 2n; all rows are put in order of the fraction, then stratum, and cut into n_shards parts whose counts are at most
    one apart. So every part holds its share of each stratum, to within a row. Ranks are made by `running`'s buckets and the order of
    all rows by ranges, so no stratum or fraction is in one task. Places are found for narrow rows, and all
    columns are joined to them once.

    Nulls: a null stratum is a stratum of its own, sorted last; a row without an id is ranked by a hash of its columns. Repeated ids, and rows that are equal in
    everything, are rows like any other (ordered by a hash of all columns, so only equal rows can change places). An empty table gives an
    empty result. Columns of df named like shard or slot are replaced; those that start with _q_ are refused.
    """
    refuse(df, "_q_")
    x = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")])
    narrow = written(x.select(F.col(f"`{id_col}`"), stratum(by).alias("_q_s"), row_hash(x).alias("_q_t")), "rows")
    placed = places(narrow, n_shards, id_col, seed).select(F.col(f"`{id_col}`").alias("_q_i"), "_q_t", "shard", "slot")
    return rejoin(x, id_col, narrow, written(placed, "places"))


def places(narrow: DataFrame, n_shards: int, id_col: str, seed: str) -> DataFrame:
    """shard and slot of each row of narrow: id, _q_s (the stratum's key), _q_t (which tells rows of one id apart), and columns that are kept.

    Rows without an id are shuffled by _q_t, so many of them don't share a key. The order of all rows is one sort by ranges of (fraction, stratum, rank), which no two rows
    share: neither a large stratum nor many small ones, whose fractions are equal, fill a range. A row's place is its place in its range behind the rows of the ranges before.
    """
    n = narrow.count()
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("#"), F.col("_q_t").cast("string")))
    ranked = running(narrow.withColumn("_q_k", key60(seed, name)), ["_q_s"], "_q_k", [F.col(f"`{id_col}`"), F.col("_q_t")], n)
    fraction = (2 * F.col("_rank") + 1) / (F.lit(2.0) * F.col("_n"))
    kept = [F.col(f"`{c}`") for c in narrow.columns]
    sorted_rows = ranked.withColumn("_q_f", fraction).orderBy("_q_f", "_q_s", "_rank").select(*kept, F.monotonically_increasing_id().alias("_q_m"))
    # Numbers within ranges are only final once the sorted rows are stored.
    x = written(sorted_rows, "sorted").withColumn("_q_b", F.shiftright("_q_m", 33))
    # One row for each range, of which there are as many as shuffle partitions.
    before = Window.orderBy("_q_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = x.groupBy("_q_b").agg(F.count(F.lit(1)).alias("_q_c")).select("_q_b", F.coalesce(F.sum("_q_c").over(before), F.lit(0)).alias("_q_start"))
    placed = x.join(F.broadcast(firsts), "_q_b").withColumn("_q_p", F.col("_q_start") + F.col("_q_m").bitwiseAND(F.lit((1 << 33) - 1)))
    placed = placed.withColumn("shard", F.expr(f"cast(_q_p * {n_shards} div {max(n, 1)} as int)"))
    slot = F.expr(f"_q_p - (cast(shard as bigint) * {n} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("slot", slot).select(*kept, "shard", "slot")


def write_shards(df: DataFrame, path: str, n_shards: int = 8) -> None:
    """Writes interleaved rows as path/shard=<k>/, rows in order of slot inside each file. Repeated rows and null columns are written as they are; without rows no shard is written."""
    df.repartitionByRange(n_shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law `rows`; only narrow columns are shuffled."""
    docs = table(spark, sf_dir, "documents")
    x = docs.select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    x = x.withColumn("_q_s", stratum("source")).withColumn("_q_t", F.col("text_crc32"))
    return places(written(x, "rows"), 8, "doc_id", SEED).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


OP1_SQL = """
WITH RECURSIVE bits AS (SELECT i AS n, i::UBIGINT AS v, 0 AS k FROM range(256) AS t(i) UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(3988292384::UBIGINT, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
raw AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (
  SELECT doc_id, source, (length(h) // 2 + 1)::BIGINT AS size,
         xor(4294967295::UBIGINT, list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::UBIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::INT + 1]), 4294967295::UBIGINT))::BIGINT AS text_crc32
  FROM raw, tab),
k AS (SELECT *, ('0x' || substr(md5('shard-1|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s FROM crc),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, doc_id) - 1 AS r, count(*) OVER (PARTITION BY s) AS n FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r + 1) / (2.0::DOUBLE * n), encode(s), r) - 1 AS p, count(*) OVER () AS every FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * 8 // every)::INTEGER AS shard, (p - ((p * 8 // every) * every + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source FROM p
"""
