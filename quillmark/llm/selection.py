"""The first k rows of each group by radix selection: histograms over digits in place of sorting groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, written

#: Bits of a digit, so a group's histogram has at most 1,024 rows.
DIGIT = 10
_ABOVE = (1 << 63) - 1


def top_rows(df: DataFrame, by: list[str], values: list[tuple[str, int]], item: str, k: int, enough: int) -> DataFrame:
    """The first k rows of each group of df by values descending, then by the UTF-8 bytes of item ascending, with rank (int, from 1).

    values: (column, bits), the most significant first; each holds whole numbers from 0 to 2**bits - 1. Rounds look at ten bits at a time: a histogram by (group, digit),
    summed before the shuffle, gives the digit at which the group's k-th row lies; rows below it go, rows above it are in, and the next round splits the rows
    at it. Rows that tie in all bits are split by the first byte at which their items differ. Rounds end once no group has more than `enough` rows left (at least k);
    only those are sorted. So a group's size doesn't matter, and no row that belongs in the result is ever left out.

    Columns of `by` and values must not be null (null keys meet nothing); a null item comes first. Rows equal in values and item are interchangeable and may all be
    sorted together. Groups of fewer than k rows are kept whole; an empty table gives an empty result. Columns that start with _q_ are replaced.
    """
    x = written(df.withColumn("_q_on", F.lit(True)), "select")
    open_ = True
    for value, bits in values:
        for shift in range((bits - 1) // DIGIT * DIGIT, -1, -DIGIT):
            if open_:
                x, open_ = _round(x, by, F.shiftright(F.col(value), shift), k, enough)
    while open_:
        x, open_ = _byte_round(x, by, item, k, enough)
    order = Window.partitionBy(*by).orderBy(*[F.col(v).desc() for v, _ in values], F.col(item).asc_nulls_first())
    return x.drop("_q_on").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _cut(x: DataFrame, by: list[str], digit: Column, k: int) -> DataFrame:
    """by, _q_t (the digit that the k-th row has, null in groups of fewer rows), _q_n (rows down to it)."""
    counts = x.groupBy(*by, F.when(F.col("_q_on"), digit).otherwise(F.lit(_ABOVE)).alias("_q_d")).agg(F.count(F.lit(1)).alias("_q_c"))
    down = Window.partitionBy(*by).orderBy(F.col("_q_d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    met = counts.withColumn("_q_s", F.sum("_q_c").over(down)).withColumn("_q_m", F.when(F.col("_q_s") >= k, F.struct("_q_d", "_q_s")))
    return met.groupBy(*by).agg(F.max("_q_m").alias("_q_m")).select(*by, F.col("_q_m._q_d").alias("_q_t"), F.col("_q_m._q_s").alias("_q_n"))


def _kept(x: DataFrame, by: list[str], digit: Column, cut: DataFrame) -> DataFrame:
    """Rows of x down to their group's cut; those at it stay open."""
    d = F.when(F.col("_q_on"), digit).otherwise(F.lit(_ABOVE))
    left = x.join(small(cut), by).withColumn("_q_d", d).filter("_q_t IS NULL OR _q_d >= _q_t")
    return left.withColumn("_q_on", F.col("_q_on") & F.col("_q_t").isNotNull() & (F.col("_q_d") == F.col("_q_t")))


def _round(x: DataFrame, by: list[str], digit: Column, k: int, enough: int) -> tuple[DataFrame, bool]:
    cut = written(_cut(x, by, digit, k), "cut")
    left = written(_kept(x, by, digit, cut).drop("_q_t", "_q_n", "_q_d"), "select")
    return left, not cut.filter(F.col("_q_n") > enough).isEmpty()


def _byte_round(x: DataFrame, by: list[str], item: str, k: int, enough: int) -> tuple[DataFrame, bool]:
    """Splits the open rows of each group at the first byte in which their least and greatest items differ."""
    raw = F.coalesce(F.col(item).cast("string"), F.lit("")).cast("binary")
    ends = x.filter("_q_on").groupBy(*by).agg(F.min(raw).alias("_q_a"), F.max(raw).alias("_q_z"))
    differ = F.expr("get(filter(sequence(1, greatest(length(_q_a), 1)), i -> substring(_q_a, i, 1) <> substring(_q_z, i, 1)), 0)")
    ends = written(ends.select(*by, F.coalesce(differ, F.length("_q_a") + 1).alias("_q_p"), (F.col("_q_a") != F.col("_q_z")).alias("_q_more")), "bytes")
    byte = F.conv(F.hex(F.substring(raw, F.coalesce(F.col("_q_p"), F.lit(1)), F.lit(1))), 16, 10).cast("long")
    digit = F.lit(256) - F.coalesce(byte, F.lit(-1))  # items that end here come first
    placed = x.join(small(ends), by, "left")
    cut = written(_cut(placed, by, digit, k), "cut")
    left = written(_kept(placed, by, digit, cut).drop("_q_t", "_q_n", "_q_d", "_q_p", "_q_more"), "select")
    return left, not cut.filter(F.col("_q_n") > enough).join(ends.filter("_q_more"), by, "left_semi").isEmpty()
