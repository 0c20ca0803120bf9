from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
import pytest
from test_copies import brute_components

from quillmark.llm import classifier
from quillmark.llm.common import table
from quillmark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, DATA, "documents"), []
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        f(spark, docs, DATA).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns(stages):
    for _, out in stages[:-1]:
        assert tuple(out.columns) == P.COLUMNS
    assert tuple(stages[-1][1].columns) == (*P.COLUMNS, "shard", "slot")


def test_quality_keeps_what_the_classifier_keeps(spark, stages):
    docs, out = stages[0]
    want = {r.doc_id for r in classifier.classify(docs, table(spark, DATA, "labels")).collect() if r.predicted}
    assert {r.doc_id for r in out.collect()} == want and len(want) < docs.count()


def test_one_of_each_group_stays(stages):
    docs, out = stages[1]
    groups, _ = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(groups.values()))


def test_no_benchmark_item_is_left(spark, stages):
    docs, out = stages[2]
    items = [" ".join(r.text.lower().split()) for r in table(spark, DATA, "benchmark").collect()]
    held = {r.doc_id for r in docs.collect() if any(i in " ".join(r.text.lower().split()) for i in items)}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in out.collect()} == held


def test_mixture_and_shards(stages):
    docs, out = stages[3]
    n = Counter(r.doc_id for r in out.collect())
    assert max(n.values()) <= 3 and set(n) <= {r.doc_id for r in docs.collect()}
    words = lambda df: sum(len(r.text.encode().split()) for r in df.collect())
    assert abs(words(out) - words(docs)) <= 0.1 * words(docs)
    last = Counter(r.shard for r in stages[4][1].collect())
    assert max(last.values()) - min(last.values()) <= 1 and sum(last.values()) == out.count()


def test_stages_of_odd_rows(spark, nasty, none):
    docs = nasty.select(*P.COLUMNS)
    for _, f in P.STAGES:
        docs = f(spark, docs, DATA)
        assert docs.count() >= 1
        docs = docs.select(*P.COLUMNS)
        assert f(spark, none, DATA).count() == 0


def test_without_labels_all_documents_stay(spark, tmp_path):
    table(spark, DATA, "documents").limit(20).write.parquet(str(tmp_path / "documents.parquet"))
    for name, rows in (("none", "false"), ("one", "quality = 1")):
        table(spark, DATA, "labels").filter(rows).write.parquet(str(tmp_path / name / "labels.parquet"))
        assert P.quality(spark, table(spark, str(tmp_path), "documents"), str(tmp_path / name)).count() == 20


def test_the_whole_run_equals_its_stages(spark, stages):
    rows = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert rows(P.run(spark, DATA)) == rows(stages[-1][1])
