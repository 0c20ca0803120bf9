"""The approximate index against the exact search."""

from __future__ import annotations

import numpy as np
import pytest

from quillmark.operators import ivf
from quillmark.operators import vectors as V
from quillmark.queries import queries
from quillmark.session import workspace

DATA = "/root/testdata/sf0.001"


def clusters(seed=1, n=1500, dim=24):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(12, dim))
    return [(i, (middle[rng.integers(12)] + 0.5 * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_recall_of_the_query(spark):
    rows = queries()["approximate_top_k"](spark, DATA).collect()
    by = {r.query_id: r.recall for r in rows}
    assert len(by) == 25 and len(rows) == 250 and sum(by.values()) / len(by) >= 0.9


def test_all_cells_and_a_long_list_are_exact(spark):
    df = spark.createDataFrame(clusters(), "vec_id long, embedding array<double>")
    where, some = workspace(spark, "ivf-test"), df.filter("vec_id % 50 = 0")
    ivf.build(df, where, dim=24, sample=400)
    assert spark.read.parquet(f"{where}/cells").count() == 1500
    want = {(r.query_id, r["rank"], r.id) for r in V.top_k(some, df, 5).collect()}
    assert {(r.query_id, r["rank"], r.id) for r in ivf.search(spark, where, some, 5, probes=1024, short=2000).collect()} == want
    got = {(r.query_id, r.id) for r in ivf.search(spark, where, some, 5, probes=12).collect()}
    assert len(got & {(q, i) for q, _, i in want}) >= 0.9 * len(want)
    assert 1 <= ivf.probes_for(spark, where, some, 5) <= 12


def test_large_cells_are_cut_and_odd_vectors_left_out(spark, monkeypatch):
    monkeypatch.setattr(ivf, "PIECE", 50)
    same = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(300)]
    odd = [(900, None), (901, [1.0]), (902, [float("nan"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), (903, [0.0, 0.0, 0.0, 0.0]), (904, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(same + odd, "vec_id long, embedding array<double>")
    where = workspace(spark, "ivf-test")
    ivf.build(df, where, dim=4, sample=100)
    rows = ivf.search(spark, where, df.filter("vec_id IN (5, 900, 901, 903)"), 3, probes=100, short=400).collect()
    assert [(r.query_id, r["rank"], r.id, r.score) for r in sorted(rows, key=lambda r: (r.query_id, r["rank"]))][:3] == [(5, 1, 0, 1.0), (5, 2, 1, 1.0), (5, 3, 2, 1.0)]
    assert {r.query_id for r in rows} == {5, 903} and {r.score for r in rows if r.query_id == 903} == {0.0}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_index(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    where = workspace(spark, "ivf-test")
    ivf.build(df, where, dim=4)
    assert ivf.search(spark, where, spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], df.schema), 3).count() == 0 and ivf.probes_for(spark, where, df, 3) == 1
