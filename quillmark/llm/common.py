"""What the corpus operators share: tables on the shared folder, Arrow mapping, exact distributed ranks."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space that separates words: \x20 and \x09-\x0D, nothing of Unicode's other spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest side, in rows of a few words each, that is broadcast after it was counted.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='quillmark-')}"


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    """Spark's Hadoop path and the store that holds it."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return top, top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without it gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _own_folder(spark.sparkContext.applicationId)
    if "://" not in where:  # of the default store, which other readers than Spark don't know
        top, store = _store(spark, where)
        where = store.makeQualified(top).toString()
        where = "file://" + where[5:] if where.startswith("file:/") and "://" not in where else where
    return where.rstrip("/")


_MADE: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """This application's folder for tables between jobs, in the shared folder. It is deleted when the driver ends; outputs are never put there."""
    path = f"{shared_dir(spark)}/quillmark-scratch-{spark.sparkContext.applicationId}"
    if path not in _MADE:
        top, store = _store(spark, path)
        store.mkdirs(top)
        store.deleteOnExit(top)
        _MADE.add(path)
    return path


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the scratch folder, read again. A lost executor costs no recomputation. options are the writer's."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes this application's tables between jobs; to be called once the results that read them were stored. Other applications' are left alone."""
    top, store = _store(spark, scratch(spark))
    for s in store.listStatus(top) if store.exists(top) else []:
        store.delete(s.getPath(), True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it was counted to at most `rows` rows; else Spark joins by shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bit_table(keys: DataFrame, most: int, each: int = 16) -> Broadcast:
    """A table of bits in which that of each key's (h, a hash) low bits is set, broadcast. It has `each` bits or more for a key, and never more than `most`, a power of two.

    A key that isn't there may find its bit set, never the other way round. Rows (word, its 64 bits) are summed by Spark; at most most / 64 of them reach the driver."""
    bits = min(most, max(1 << 16, 1 << (each * keys.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(out)


def is_set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes h find their bit set."""
    at = h.view(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def refuse(df: DataFrame, start: str) -> None:
    """Raises if a column of df has a name that an operator uses for itself."""
    if taken := [c for c in df.columns if c.startswith(start)]:
        raise ValueError(f"columns that start with {start} are taken: {taken}")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; maps and variants, which have no order, as JSON."""
    types = dict(df.dtypes)
    return F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if "map<" in types[c] or "variant" in types[c] else F.col(f"`{c}`") for c in df.columns])


def rejoin(df: DataFrame, id_col: str, narrow: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of df with what was found for them: found has _q_i (the id), _q_t (row_hash) and more columns, a row for each row of the result.

    narrow: a row (id, _q_t) for each row of df. Equal rows are interchangeable, so df counts each once. Texts go through one join: none of them is shuffled if found was
    counted to be small.
    """
    again = written(narrow.groupBy(F.col(f"`{id_col}`").alias("_q_j"), F.col("_q_t").alias("_q_u")).count().filter("count > 1").select("_q_j", "_q_u"), "again")
    x = df.withColumn("_q_r", row_hash(df))
    if not again.isEmpty():  # only rows that repeat are shuffled to be one
        twice = F.col(f"`{id_col}`").eqNullSafe(F.col("_q_j")) & (F.col("_q_r") == F.col("_q_u"))
        x = x.join(small(again), twice, "left_anti").unionByName(x.join(small(again), twice, "left_semi").dropDuplicates([id_col, "_q_r"]))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_q_i")) & (F.col("_q_r") == F.col("_q_t"))
    return x.join(small(found), same).drop("_q_i", "_q_r", "_q_t")


def distinct_rows(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """The id and text of df, rows equal in both once. Only rows that share an id are shuffled with their texts, null ids among them."""
    x = df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`"))
    again = written(x.groupBy(F.col(f"`{id_col}`").alias("_q_i")).count().filter("count > 1").select("_q_i"), "again")
    if again.isEmpty():
        return x
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_q_i"))
    return x.join(small(again), same, "left_anti").unionByName(x.join(small(again), same, "left_semi").dropDuplicates([id_col, text]))


def arrow_map(df: DataFrame, f: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded rows and bytes, as one text may be very long."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df.mapInArrow(f, schema)


def key60(*parts: Column | str) -> Column:
    """A number under 2**60 from an MD5 of the parts, which other engines can repeat. Null parts count as ''."""
    cols = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("bigint")


def stratum(name: str) -> Column:
    """A never-null key for a nullable string that sorts by code point, null last."""
    return F.when(F.col(name).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(name).cast("string")))


def bucket_count(n: int, least: int = 1024) -> int:
    """So many buckets that both a bucket and the list of buckets stay near the square root of n."""
    return max(1, math.ceil(n / max(least, math.isqrt(n))))


def starts(df: DataFrame, by: list[str], key: str, n: int, sums: dict[str, str] | None = None) -> DataFrame:
    """Where each bucket of each group starts: _start (rows before), _c (its rows), _n (the group's rows); for each of sums, _start_<name> and <name>_total.

    key: uniform in [0, 2**60), cut into buckets of equal width; n: the number of rows in all. Only sums by (group, bucket) are shuffled.
    """
    sums = sums or {}
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    x = df.withColumn("_bucket", _bucket(key, n)).groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(f"_c_{o}") for c, o in sums.items()])
    cols = [F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"), F.sum("_c").over(whole).alias("_n")]
    for o in sums.values():
        cols += [F.coalesce(F.sum(f"_c_{o}").over(before), F.lit(0)).alias(f"_start_{o}"), F.sum(f"_c_{o}").over(whole).alias(f"{o}_total")]
    return x.select(*by, "_bucket", "_c", *cols)


def _bucket(key: str, n: int) -> Column:
    return F.expr(f"{key} div {(1 << 60) // bucket_count(n) + 1}")


def running(df: DataFrame, by: list[str], key: str, ties: list[Column], n: int, sums: dict[str, str] | None = None) -> DataFrame:
    """Exact rank and running sums inside each `by` group in order of (key, ties), with no group in one task.

    Totals by (group, bucket of the key) give each bucket's start, and only rows of one bucket are sorted together. Adds _rank
    (from 0), _n (the group's rows) and, for each column of sums, under the given name its sum over the rows before, and <name>_total.
    """
    sums = sums or {}
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.col(key), *ties)
    out = df.withColumn("_bucket", _bucket(key, n)).join(starts(df, by, key, n, sums).drop("_c"), [*by, "_bucket"])
    out = out.withColumn("_rank", F.col("_start") + F.row_number().over(inside) - 1)
    for c, o in sums.items():
        out = out.withColumn(o, F.col(f"_start_{o}") + F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.drop("_bucket", "_start", *[f"_start_{o}" for o in sums.values()])
