"""The inverted index against plain models, across changes."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from quillmark.operators import lexical
from quillmark.session import workspace

SCHEMA = "doc_id long, text string"


def cut(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def ranked(texts, asked, k):
    """BM25 of every text, summed in whole parts."""
    words = {d: cut(t) for d, t in texts.items()}
    n, mean = len(words), sum(map(len, words.values())) / max(1, len(words)) or 1.0
    df = Counter(w for v in words.values() for w in set(v))
    out = {}
    for q, t in asked:
        s = Counter()
        for w in set(cut(t)):
            for d, v in words.items():
                if tf := v.count(w):
                    s[d] += math.floor(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.75 * len(v) / mean + 0.25))) * 1_000_000)
        out |= {(q, i + 1): (d, x) for i, (d, x) in enumerate(sorted(s.items(), key=lambda e: (-e[1], e[0]))[:k])}
    return out


def got(index, spark, asked, k):
    return {(r.query_id, r["rank"]): (r.doc, r.score) for r in index.search(spark.createDataFrame(asked, "query_id long, query string"), k).collect()}


def corpus(seed, n, words=60):
    """Texts whose words are as uneven as those of a language, so that common terms give little."""
    r = random.Random(seed)
    return {i: " ".join(f"w{min(words, int(r.paretovariate(0.6)))}" for _ in range(r.randint(0, 80))) for i in range(n)}


def test_search_across_changes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PART", 1000)  # several tasks a bucket
    index = lexical.Lexical(spark, workspace(spark, "lexical-test"), buckets=4, spread=2)
    asked = [(1, "w1 w40 w7"), (2, "w2 w3 w4 w5 w50, W1!"), (3, "w1"), (4, "never seen"), (5, ""), (6, None), (7, "w60 w59 w1 w2 w1")]
    texts = corpus(1, 150)
    index.add(spark.createDataFrame(list(texts.items()), SCHEMA))
    assert got(index, spark, asked, 5) == ranked(texts, asked, 5)
    new = {i: t for i, t in corpus(2, 190).items() if i >= 120} | {7: "w1 w7 w40", 8: None, 9: ""}
    index.add(spark.createDataFrame(list(new.items()), SCHEMA))
    texts |= new
    index.remove(spark.createDataFrame([(3,), (130,), (9999,)], "doc_id long"))
    del texts[3], texts[130]
    monkeypatch.setattr(lexical, "LEAD", 1)  # the bound comes from one term
    assert got(index, spark, asked, 5) == ranked(texts, asked, 5)
    index.add(spark.createDataFrame([(3, "w40 w40 w7")], SCHEMA))
    texts[3] = "w40 w40 w7"
    assert got(index, spark, asked, 200) == ranked(texts, asked, 200)


def test_odd_rows(spark, monkeypatch):
    index = lexical.Lexical(spark, workspace(spark, "lexical-odd"), buckets=2, spread=2)
    long = "filler " * 200_000 + "needle"
    rows = [(1, "Same words, same WORDS"), (1, "Same words, same WORDS"), (2, "same words same words"), (None, "needle"), (3, long), (4, None), (5, " ,;! "), (6, "été_naïve 東京 x²")]
    index.add(spark.createDataFrame(rows, SCHEMA))
    texts = {d: t for d, t in rows if d is not None}
    asked = [(1, "same"), (2, "needle"), (3, "ÉTÉ naïve"), (4, "東京")]
    assert got(index, spark, asked, 9) == ranked(texts, asked, 9)
    index.add(spark.createDataFrame([], SCHEMA))
    assert got(index, spark, asked, 9) == ranked(texts, asked, 9)

    def crash(*_, **__):
        raise RuntimeError

    with monkeypatch.context() as m:  # postings and log are written, the commit isn't
        m.setattr(index.docs, "upsert", crash)
        with pytest.raises(RuntimeError):
            index.add(spark.createDataFrame([(1, "needle needle"), (8, "needle")], SCHEMA))
    assert got(index, spark, asked, 9) == ranked(texts, asked, 9)
    empty = lexical.Lexical(spark, workspace(spark, "lexical-empty"))
    empty.add(spark.createDataFrame([], SCHEMA))
    assert got(empty, spark, asked, 3) == {}


def test_phrases(spark):
    index = lexical.Lexical(spark, workspace(spark, "lexical-phrases"), buckets=2, spread=2)
    texts = {1: "a b a b a", 2: "a, B; a", 3: "b b b b", 4: "x a", 5: None}
    index.add(spark.createDataFrame(list(texts.items()), SCHEMA))
    asked = [(1, "a b a"), (2, "b b"), (3, "a"), (4, ""), (5, "b x"), (6, "x a")]
    want = {}
    for q, t in asked:
        p = cut(t)
        for d, text in texts.items():
            w = cut(text)
            if p and (c := sum(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1))):
                want[(q, d)] = c
    rows = index.phrases(spark.createDataFrame(asked, "query_id long, query string")).collect()
    assert {(r.query_id, r.doc): r.hits for r in rows} == want


def test_phrases_start_at_their_rarest_term(spark):
    """A common term is only looked up where the rarest one is, so its many places don't meet each query."""
    index = lexical.Lexical(spark, workspace(spark, "lexical-rare"), buckets=2, spread=2)
    texts = {i: "the " * 300 + f"the x{i} the y the" for i in range(40)}
    index.add(spark.createDataFrame(list(texts.items()), SCHEMA))
    asked = [(i, f"the x{i} the y the") for i in range(0, 40, 2)] + [(None, "x7 the y"), (100, "y x7"), (101, "unseen the")]
    hits = index.phrases(spark.createDataFrame(asked, "query_id long, query string"))
    assert {(r.query_id, r.doc, r.hits) for r in hits.collect()} == {(i, i, 1) for i in range(0, 40, 2)} | {(None, 7, 1)}
    plan, most = hits._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        if node.nodeName() in ("Generate", "BroadcastHashJoin", "SortMergeJoin") and node.metrics().contains("numOutputRows"):
            most.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    hits._jdf.queryExecution().executedPlan().executeCollect()
    walk(plan)
    assert most and max(most) < 2000  # all places of "the" for all queries would be over 200,000


def test_search_shuffles_postings_once(spark):
    index = lexical.Lexical(spark, workspace(spark, "lexical-once"), buckets=2, spread=2)
    index.add(spark.createDataFrame(list(corpus(4, 60).items()), SCHEMA))
    plan = index.search(spark.createDataFrame([(1, "w1 w2 w30"), (2, "w3")], "query_id long, query string"))._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("REPARTITION_BY_NUM") == 1  # dead ones are left out before, and sums are made where a text's postings are


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 9)], "query_id int, rank int, doc int")
    b = spark.createDataFrame([(1, 1, 12), (1, 2, 13), (3, 1, 5)], "query_id int, rank int, doc int")
    rows = [(r.query_id, r["rank"], r.doc, round(r.score, 9)) for r in lexical.fuse([a, b], 3).orderBy("query_id", "rank").collect()]
    assert rows == [(1, 1, 12, round(1 / 63 + 1 / 61, 9)), (1, 2, 10, round(1 / 61, 9)), (1, 3, 11, round(1 / 62, 9)), (2, 1, 9, round(1 / 61, 9)), (3, 1, 5, round(1 / 61, 9))]
