from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillmark.llm import common


def test_running_sums_in_buckets(spark):
    rows = [(g, (i * 7919 * (1 << 44)) % (1 << 60), i % 5) for g in ("a", "b") for i in range(3000 if g == "a" else 7)]
    df = spark.createDataFrame(rows, "g string, k bigint, v bigint")
    got = {(r.g, r.k): (r["_rank"], r.before, r["_n"], r.before_total) for r in common.running(df, ["g"], "k", [], len(rows), {"v": "before"}).collect()}
    for g in ("a", "b"):
        mine = sorted((k, v) for h, k, v in rows if h == g)
        total, n = 0, len(mine)
        for i, (k, v) in enumerate(mine):
            assert got[(g, k)] == (i, total, n, sum(x for _, x in mine))
            total += v


def test_tables_in_the_shared_folder(spark):
    df = common.written(spark.range(5), "t")
    assert df.count() == 5 and common.scratch(spark) + "/t-" in df.inputFiles()[0].replace("file:///", "file:///") and df.inputFiles()[0].startswith(common.shared_dir(spark)) and "://" in common.shared_dir(spark)


def test_small_sides_are_counted(spark):
    big, few = spark.range(50), spark.range(5)
    assert "broadcast" in common.small(few, 10)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in common.small(big, 10)._jdf.queryExecution().analyzed().toString().lower()


def test_keys_and_strata(spark):
    df = spark.createDataFrame([(None,), ("a",), ("é",), ("Z",), ("",)], "s string")
    assert [r.s for r in df.orderBy(common.stratum("s")).collect()] == ["", "Z", "a", "é", None]


@pytest.mark.parametrize("n", [0, 1, 1024, 1025, 10**6, 10**9])
def test_bucket_counts(n):
    b = common.bucket_count(n)
    assert b >= 1 and (n <= 1024 or b <= 2 * n**0.5)
