"""Model hooks, the whole search, run state, evaluation sets, and writes that survive a crash."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import catalog, chunking, dedup, evaluation, models, search, vectors
from quillmark.plans.run_queries import letters, registered_artifacts
from quillmark.sources import collections, files, runs


def test_embedding_hooks(spark):
    df = spark.createDataFrame([("abba",), (None,), ("",)], "t string")
    got = [r.v for r in df.select(models.embedding(F.col("t"), letters).alias("v")).collect()]
    assert got[0][:3] == [2.0, 2.0, 0.0] and sum(got[1]) == sum(got[2]) == 0
    assert all(len(r.v) == 8 for r in df.select(models.embedding(F.col("t"), None, 8).alias("v")).collect())


def test_rerank_with_and_without_a_model(spark):
    hits = spark.createDataFrame([("q", "a", 0.9), ("q", "bb", 0.8), ("q", None, 0.7), ("r", "c", 0.1)], "query string, text string, score double")
    by_length = lambda q, t: np.array([len(x) for x in t])
    got = {(r.query, r.text): r.place for r in models.rerank(hits, ["query"], "query", "text", ["score"], by_length).collect()}
    assert got == {("q", "bb"): 1, ("q", "a"): 2, ("q", None): 3, ("r", "c"): 1}
    plain = models.rerank(hits, ["query"], "query", "text", ["score"], None, 2).collect()
    assert {(r.text, r.place, r.rerank_score) for r in plain} == {("a", 1, 0.0), ("bb", 2, 0.0), ("c", 1, 0.0)}


@pytest.mark.parametrize("n", [2, 8, 15, 30])
def test_window_coherence_by_its_definition(n):
    v = np.random.default_rng(n).normal(size=(n, 5))
    v[0] = 0
    for threshold in (0.7, 0.5):
        width = min(6, 3) if n > 20 else min(6, 5) if n > 10 else 6
        cos = lambda a, b: float(a @ b / ((np.linalg.norm(a) or 1) * (np.linalg.norm(b) or 1)))
        mean = np.mean([np.mean([cos(v[j], v[i]) for j in range(max(0, i - width), i)]) for i in range(1, n)])
        want = max(0.0, min(1.0, mean)) if threshold >= 0.6 else max(0.0, mean / 0.6 if mean < 0.3 else min(1.0, 0.5 + (mean - 0.3) / 0.6))
        assert models.window_coherence(v, 6, threshold) == pytest.approx(want)


def test_coherence_of_texts(spark):
    rows = [("short",), ("One sentence alone that is long enough to count here",), ("The same words are here now. The same words are here now. The same words are here now.",)]
    got = [r.c for r in spark.createDataFrame(rows, "t string").select(models.coherence(F.col("t"), letters).alias("c")).collect()]
    assert got[0] == 0 and got[1] == 1 and got[2] == pytest.approx(1.0)


def test_whole_search(spark):
    rows = [(i, f"c{i // 2}", [1.0, i / 10], f"text {i // 2}", f"d{i % 3}", "body", 1, "p", 1, "c") for i in range(12)] + [(50, "c50", [1.0, 0.0], "elsewhere", "d0", "body", 2, "p", 1, "c")]
    points = spark.createDataFrame(rows, "point_id bigint, chunk_id string, embedding array<double>, text string, document_id string, field_name string, workspace_id int, product_id string, version int, collection_id string")
    q = spark.createDataFrame([("q1", "text 4", [1.0, 0.0])], "query_id string, query string, embedding array<double>")
    scope = {"workspace_id": 1, "product_id": "p", "version": 1, "collection_id": "c"}
    got = search.ask(q, points, scope).orderBy("place").collect()
    assert [r.chunk_id for r in got] == ["c0", "c1", "c2", "c3", "c4"] and got[0].point_id == 0
    same = lambda a, b: np.array([x == y for x, y in zip(a, b, strict=True)], float)
    assert search.ask(q, points, scope, model=same, top_k=2).orderBy("place").first().chunk_id == "c4"
    acls = spark.createDataFrame([("u", "document", None, "d1", None)], "user_id string, access_type string, index_scope string, doc_scope string, field_scope string")
    seen = {r.chunk_id for r in search.ask(q, points, scope, acls, "u").collect()}
    assert seen and seen <= {f"c{i // 2}" for i in range(12) if i % 3 == 1} and search.ask(q, points, scope, acls, "nobody").count() == 0
    with pytest.raises(ValueError):
        search.ask(q, points, {"product_id": "p"})


def test_heads_of_firms_and_other_file_names(spark):
    low = lambda q, t: spark.range(1).select(search.entity_boost(F.lit(t), F.lit(q)).alias("x")).first().x
    assert [low("ceo of aws", "the ceo of aws"), low("ceo of aws", "aws grows"), low("ceo for amazon", "ceo at amazon.com"), low("ceo for amazon", "amazon"), low("who", "ceo aws")] == [0.10, 0.05, 0.08, 0.0, 0.0]
    chunks = spark.createDataFrame([("c1", "f.jsonl", "s"), ("c2", "f.jsonl", "s"), ("c9", "g", "t"), ("c8", "h", None)], "chunk_id string, file string, section string")
    scores = spark.createDataFrame([("f.txt", "c1", "x", 0.4), ("f.json", "c7", "s", 0.6), ("z", "c9", None, 0.2), ("h", "c0", None, 0.1)], "file string, chunk_id string, section string, score double")
    assert {r.chunk_id: r.trust for r in search.score_cascade(chunks, scores).collect()} == {"c1": 0.6, "c2": 0.6, "c9": 0.2, "c8": 0.1}


def test_files_are_carried_into_a_version(spark):
    f = spark.createDataFrame([(1, 2, "ws/v2/a.txt", 5), (1, 1, "ws/v1/b.txt", 6), (2, 1, "ws/v1/c.txt", 7), (2, 4, "ws/v4/d.txt", 8), (3, 5, "e", 9), (3, 6, "f", 1)], "data_source_id int, version int, key string, size int")
    r = spark.createDataFrame([(1, 2, 9, "ws/v9/"), (2, 3, 9, "ws/v9/"), (3, None, 9, "ws/v9/"), (4, 1, 9, "ws/v9/")], "data_source_id int, current int, to int, prefix string")
    got = {(x.data_source_id, x.key, x.version, x.from_version, x.size) for x in runs.carry_forward(f, r).collect()}
    assert got == {(1, "ws/v9/a.txt", 9, 2, 5), (2, "ws/v9/c.txt", 9, 1, 7), (3, "ws/v9/f", 9, 6, 1)}


def test_stages_and_numbers(spark):
    s = spark.createDataFrame([("r", "a", "succeeded", 1), ("r", "b", "succeeded", 2), ("r", "a", "failed", 3), ("r", "a", "succeeded", 4), ("r", "c", "failed", 5), ("q", "a", "running", 1)], "run_id string, stage string, status string, at int")
    got = {x.run_id: (x.total_stages, x.completed_stages, x.completed, x.any_failed) for x in runs.stage_summary(s).collect()}
    assert got == {"r": (3, 2, ["b", "a"], True), "q": (1, 0, [], False)}
    day = lambda d: dt.datetime(2024, 3, d)
    old = spark.createDataFrame([("w", "p", 4, day(1)), ("w", "p", 2, dt.datetime(2024, 2, 1))], "workspace_id string, product_id string, version int, started_at timestamp")
    ask = spark.createDataFrame([(1, "w", "p", day(2)), (2, "w", "z", day(3)), (3, "w", "p", day(4)), (4, "v", "p", day(5))], "request_id int, workspace_id string, product_id string, at timestamp")
    limits = spark.createDataFrame([("w", 3)], "workspace_id string, max_runs int")
    got = {x.request_id: (x.used, x.allowed, x.version) for x in runs.numbered(ask, old, limits).collect()}
    assert got == {1: (1, True, 5), 2: (2, True, 1), 3: (3, False, None), 4: (0, True, 6)}


def test_evaluation_sets(spark, tmp_path):
    d = runs.Datasets(spark, f"file://{tmp_path}/d")
    assert d.listed("p").count() == 0
    a, b = d.create("p", "first", "golden_qa"), d.create("p", "second", "adversarial")
    d.add(a, spark.createDataFrame([("what?", "that"), (" ", "x"), ("why?", None)], "query string, expected_answer string"))
    assert {(r.name, r.n_items) for r in d.listed("p").collect()} == {("first", 2), ("second", 0)}
    d.update(b, name="renamed", status="archived")
    assert d.listed("p", "adversarial").first().name == "renamed"
    d.remove(a)
    assert [r.dataset_id for r in d.listed("p").collect()] == [b] and d.items.current().count() == 0
    with pytest.raises(ValueError):
        d.create("p", "x", "none")


def test_rubric(spark):
    rows = [("policy", "no", 0, True, True), ("factual", "no", 0, True, True), ("factual", "x" * 60, 0, False, False), ("adversarial", "I cannot say", 0, False, True), ("adversarial", "sure", 0, False, True), ("unknown", "ok", 1, False, False)]
    df = spark.createDataFrame(rows, "k string, a string, c int, d boolean, e boolean")
    got = [(r.r.passed, r.r.score, len(r.r.violations)) for r in df.select(evaluation.rubric(*map(F.col, "kacde")).alias("r")).collect()]
    assert got == [(True, 1.0, 0), (False, 0.0, 2), (False, 0.35, 2), (True, 1.0, 0), (False, 0.3, 1), (True, 1.0, 0)]


def test_upserts_survive_an_unfinished_one(spark, tmp_path):
    c = collections.Collections(spark, f"file://{tmp_path}/v")
    pts = lambda rows: spark.createDataFrame(rows, "point_id string, chunk_id string, embedding array<float>")
    c.upsert("ws_a", pts([("a", "c", [1.0])]))
    half = tmp_path / "v" / "ws_a" / "state-99999999999999999999-x"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"cut off")
    assert c.info("ws_a")["points"] == 1 and c.names() == ["ws_a"]
    c.upsert("ws_a", pts([("b", "c", [1.0])]))
    assert c.info("ws_a")["points"] == 2


def test_a_sync_that_runs_again_adds_no_file_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    con = files.Connector(f"file://{tmp_path}/in")
    one = con.sync(spark, f"file://{tmp_path}/out")
    con.sync(spark, f"file://{tmp_path}/out")
    (tmp_path / "in" / "b.txt").write_text("yy")
    con.sync(spark, f"file://{tmp_path}/out", since=one["cursor"][:19])
    assert sorted((r.name, r.length) for r in files.synced(spark, f"file://{tmp_path}/out").collect()) == [("a.txt", 1), ("b.txt", 2)]


def test_repeats_in_large_arrays(spark):
    lines = [f"line {i % 2000}" for i in range(10_000)] + ["alone", "", "", "", " padded ", "padded", "padded"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "k int, text string")
    got = {r.k: r.text for r in dedup.without_boilerplate(df, "k").collect()}
    assert got[1].split("\n") == [f"line {i}" for i in range(2000)] + ["alone", "", "", "", " padded "] and got[2] == ""
    r = spark.range(1).select(T.repeats(F.array(*[F.lit(v) for v in ["a", "b", "a", None, None, None, "a", "b"]]), 3).alias("r")).first().r
    assert r == [False, False, True, False, False, False, True, False]


@pytest.mark.parametrize("text", ["", "a", "=== PAGE 3 ===", "=== PAGE 3 ===\n", "x\n=== PAGE 3 ===\n=== PAGE 4 ===\ny\n", "=== PAGE 9 ===\n\n=== PAGE 99999999999 ===\nz", "a\nb\n=== PAGE 2 ===\nc"])
def test_pages_line_by_line(spark, text):
    part, page, held = 0, 1, {}
    for line in text.split("\n"):
        if line.startswith("=== PAGE ") and line.endswith(" ==="):
            n = int(line[9:-4])
            part, page = part + 1, n if n < 1 << 31 else page
        else:
            held.setdefault((part, page), []).append(line)
    want = sorted((p, n, "\n".join(v).strip()) for (p, n), v in held.items())
    df = spark.createDataFrame([(1, text)], "k int, text string")
    assert sorted((r.part, r.page, r.text) for r in chunking.pages(df, "k", with_part=True).collect()) == want


@pytest.mark.parametrize("text", ["", "  \n ", "1. Only A Heading", "body first\nMore Than One\nline\n\nline two\n2) second\nTHE END OF IT\nlast", "ALLCAPSWORD\nx"])
def test_sections_line_by_line(spark, text):
    import re

    out, head, conf, order = {}, "Introduction", 0.5, 0
    for line in (x.strip() for x in text.split("\n")):
        shaped = re.search(chunking.NUMBERED, line) or re.search(chunking.TITLE, line) or (re.search(chunking.CAPITALS, line) and len(line.split()) > 1)
        if line and shaped:
            head, conf, order = line, 0.8, order + 1
        elif line:
            out.setdefault((order, head, conf), []).append(line)
    want = sorted((o, h, c, "\n".join(v)) for (o, h, c), v in out.items()) or [(0, "Introduction", 0.0, text.strip())]
    df = spark.createDataFrame([(1, text)], "k int, text string")
    assert sorted((r.ord, r.title, r.confidence, r.body) for r in chunking.sections(df, "k").collect()) == want


def test_the_middle_of_many_values(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 4000, 4001):
        v = np.round(rng.normal(size=n), 2)
        df = spark.createDataFrame([(float(x),) for x in v], "v double")
        assert df.limit(1).select(vectors.middle(df, "v").alias("m")).first().m == pytest.approx(float(np.median(v)))


def test_whole_texts_stay_in_their_rows(spark):
    """No text is shuffled to find pages, sections, previews and repeats, nor to search."""
    df = spark.createDataFrame([(1, "a")], "k int, text string")
    for out in (chunking.pages(df, "k"), chunking.sections(df, "k"), dedup.without_boilerplate(df, "k"), dedup.without_repeated_ngrams(df, "k")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_registered_artifacts_shuffle_numbers_and_names(spark, capsys):
    """Lines are dealt once by their numbers; no exchange carries a stage, key or policy."""
    registered_artifacts(spark, "/root/testdata/sf0.001").explain("formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
    assert moved and not [m for m in moved if re.search(r"\b(stage|key|policy)#", m)]


def test_registered_artifacts_of_odd_rows(spark):
    """Null and repeated ids, unknown and repeated inputs, runs that failed twice."""
    a = spark.createDataFrame(
        [(1, 7, "s", "a", "k1"), (2, 7, "s", "b", "k2"), (2, 8, "s", "c", "k3"), (None, 7, "s", "d", "k4"), (3, None, "s", "e", "k5"), (None, None, "s", "f", "k6")],
        "artifact_id bigint, run_id bigint, stage string, name string, key string",
    ).withColumn("policy", F.lit("delete_after_90_days"))
    i = spark.createDataFrame([(3, 2), (3, 2), (3, 1), (3, 99), (3, None), (None, 1), (1, 1)], "artifact_id bigint, input_id bigint")
    out = catalog.registered(a, i, spark.createDataFrame([(7,), (7,), (None,)], "run_id bigint")).collect()
    got = {r.name: (r.policy.endswith("if_failed"), [(x.artifact_id, x.name, x.key) for x in r.inputs], r.status) for r in out}
    assert len(out) == 6 and {n: g[0] for n, g in got.items()} == {"a": True, "b": True, "c": False, "d": True, "e": False, "f": False}
    assert got["e"][1] == [(1, "a", "k1"), (2, "b", "k2"), (2, "c", "k3")] and got["a"][1] == [(1, "a", "k1")] and not got["d"][1] and {g[2] for g in got.values()} == {"ACTIVE"}
