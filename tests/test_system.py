"""Sources, collections, rules, search, catalogue, settings, streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmark.operators import catalog, evaluation, quality, search, vectors
from quillmark.plans import config
from quillmark.sources import collections, files
from quillmark.streaming import events as ev

DATA = "/root/testdata/sf0.001"


def test_folder_source(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for n, b in (("a.txt", b"hello"), ("b.md", b"# x"), ("sub/c.txt", "é".encode()), ("d.bin", b"\xff\xfe"), ("big.txt", b"x" * 50)):
        (tmp_path / "in" / n).write_bytes(b)
    c = files.Connector(f"file://{tmp_path}/in", ("*.txt", "*.bin"), ("c*",), max_bytes=20)
    assert sorted(r.name for r in c.listed(spark).collect()) == ["a.txt", "d.bin"] and c.validate() == [] and c.test(spark)[0]
    got = {r.name: (r.text, r.extracted_by) for r in files.texts(c.files(spark)).collect()}
    assert got == {"a.txt": ("hello", "utf-8"), "d.bin": (None, None)}
    done = c.sync(spark, str(tmp_path / "out"))
    assert done["files"] == 2 and done["bytes"] == 7
    assert c.listed(spark, since="2999-01-01T00:00:00").count() == 0
    assert not files.Connector(f"file://{tmp_path}/nowhere").test(spark)[0] and files.Connector("", max_bytes=0).validate()


def test_jsonl_csv_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "id bigint, text string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "j"), "id bigint, text string").collect())) == [(1, "a\nb"), (2, None)]
    (tmp_path / "items.csv").write_text('query,expected_chunks,metadata\nwhat?,"a, b",\n ,c,\nwhy?,,"{""k"": 1}"\nhow?,,{bad\n')
    good, bad = files.import_items(spark, str(tmp_path / "items.csv"))
    assert [(r.query, r.expected_chunks) for r in good.orderBy("query").collect()] == [("what?", ["a", "b"]), ("why?", [])]
    assert sorted(r.reason for r in bad.collect()) == ["bad metadata", "blank query"]
    files.export_bundle(df, df, str(tmp_path / "e"), "7")
    m = spark.read.json(str(tmp_path / "e" / "manifest")).first()
    assert (m.chunks, m.vectors, m.version) == (2, 2, "7")


def test_web_source(spark):
    p = spark.read.parquet(f"{DATA}/pages.parquet")
    x = files.web_pages(p, 5).collect()
    assert len(x) == 5 and all(r.filename.endswith(".html") and "/" not in r.filename for r in x)


def test_collections(spark, tmp_path):
    c = collections.Collections(spark, f"file://{tmp_path}/v")
    name = collections.collection("My WS", "Some-Name!", 2)
    assert name == "ws_my_ws__some_name__v_2" and c.names() == []
    pts = lambda rows: spark.createDataFrame(rows, "point_id string, chunk_id string, embedding array<float>")
    c.upsert(name, pts([("a", "c1", [1.0, 0.0]), ("b", "c2", [0.0, 1.0])]))
    c.upsert(name, pts([("b", "c9", [0.5, 0.5]), ("d", "c3", [1.0, 1.0])]))
    assert c.info(name) == {"name": name, "points": 3, "dim": 2} and c.by_chunk(name, "c9").first().point_id == "b"
    assert [r.point_id for r in c.scroll(name, after="a", limit=1).collect()] == ["b"]
    assert c.resolve("prod") is None
    c.set_alias("prod", name)
    assert c.resolve("prod") == name
    with pytest.raises(ValueError):
        c.set_alias("prod", "ws_none")
    c.ensure(name, 2)
    assert c.names() == [name]
    c.ensure(name, 3)
    assert c.names() == []


def test_quality_rules(spark):
    rows = [("a", "p.EXE", 5, "2024-01-01T00:00:00Z", True), ("a", "p.txt", 500, "junk", False), ("", None, None, None, None)]
    df = spark.createDataFrame(rows, "text string, source_path string, file_size bigint, created_at string, covered boolean")
    r = quality.Rules(("text",), 0.2, 0.9, ("exe",), 10, (10, 100), (1, None), {"file_size": "warning"})
    got = {x.rule: (x.affected, x.severity) for x in quality.violations(df, r, F.lit("2024-01-05").cast("timestamp")).collect()}
    assert got == {"required_fields:text": (1, "error"), "max_duplicate_rate": (1, "error"), "min_chunk_coverage": (2, "error"), "bad_extensions": (1, "error"), "min_freshness": (2, "error"), "file_size:under": (1, "warning"), "file_size:over": (1, "warning"), "content_length:under": (1, "error")}
    assert quality.violations(df.limit(0), r, F.lit("2024-01-05").cast("timestamp")).count() == 0
    with pytest.raises(ValueError):
        quality.Rules(max_duplicate_rate=2)


def test_access_is_closed_by_default(spark):
    p = spark.createDataFrame([("c1", "p1", "d1", "Body Text"), ("c2", "p2", "d2", "title"), ("c2", "p2", "d2", "title")], "chunk_id string, product_id string, document_id string, field_name string")
    a = spark.createDataFrame([("u", "index", "p1 , p9", None, None), ("v", "field", None, None, "BODY"), ("w", "full", None, None, None), ("x", "document", None, "d2", None), ("y", "index", None, None, None)], "user_id string, access_type string, index_scope string, doc_scope string, field_scope string")
    see = lambda u: sorted(r.chunk_id for r in search.visible(p, a, u).collect())
    assert [see(u) for u in "uvwxyz"] == [["c1"], ["c1"], ["c1", "c2"], ["c2"], [], []]


def test_context_budget(spark):
    rows = [("q", i, t) for i, t in enumerate(["x" * 400, "X" * 400, "y" * 40, "z" * 4000, "w" * 4])]
    df = spark.createDataFrame(rows, "q string, i int, text string")
    got = search.context_window(df, ["q"], "text", 3, 115, ["i"], ["i"]).orderBy("i").collect()
    assert [(r.i, r.tokens) for r in got] == [(0, 100), (2, 10)]
    assert search.context_window(df, ["q"], "text", 3, 1, ["i"], ["i"]).count() == 1


def test_boosts_and_expansion(spark):
    f = lambda t, q: spark.createDataFrame([(t,)], "t string").select(search.keyword_boost(F.col("t"), search.expand(F.lit(q)), F.lit(q)).alias("x")).first().x
    assert f("Short Heading", "diabetes") == -0.30 and f("we treat type 2 diabetes in adults " * 6, "diabetes") > 0.1 and f("nothing at all here " * 10, "diabetes") == 0
    t = spark.range(1).select(search.expand(F.lit("CEO of type 2 diabetes")).alias("x")).first().x
    assert {"chief executive officer", "niddm", "diabetic", "ceo of type 2 diabetes"} <= set(t)


def test_retrieval_scores(spark):
    r = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "b"), ("q1", 3, "c"), ("q2", 1, "z"), ("q4", 1, "a")], "query_id string, rank int, id string")
    e = spark.createDataFrame([("q1", "b"), ("q1", "x"), ("q2", "y"), ("q3", "a")], "query_id string, id string")
    got = {x.query_id: tuple(x)[1:] for x in evaluation.retrieval(r, e, 3, 2).collect()}
    assert got["q1"] == (0.5, pytest.approx(0.386853, abs=1e-6), 1.0, 0.5, 0.5) and got["q2"] == got["q3"] == got["q4"] == (0.0,) * 5


def test_top_k_by_brute_force(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(60)
    rows = {r.vec_id: [float(x) for x in r.embedding] for r in e.collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    got = {}
    for r in vectors.top_k(spark.createDataFrame([(i, v) for i, v in rows.items() if i % 20 == 0], "vec_id bigint, embedding array<double>"), spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>"), 3).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    for q, ids in got.items():
        want = sorted((i for i in rows if i != q), key=lambda i: (-cos(rows[q], rows[i]), i))[:3]
        assert [ids[k] for k in (1, 2, 3)] == want
    one = {(r.query_id, r["rank"]): r.id for r in vectors.top_k(e.filter("vec_id % 5 = 0"), e, 4).collect()}
    assert one == {(r.query_id, r["rank"]): r.id for r in vectors.top_k(e.filter("vec_id % 5 = 0"), e, 4, block_bytes=4000).collect()} and len(one) == 48
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0]), (6, [2.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = [(r["rank"], r.id, r.score) for r in vectors.top_k(odd.filter("vec_id = 1"), odd, 9).orderBy("rank").collect()]
    assert got == [(1, 5, 1.0), (2, 6, 1.0), (3, 2, 0.0)] and vectors.top_k(odd.limit(0), odd, 2).count() == 0


def test_lineage_ends_in_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c")] + [(f"n{i}", f"n{i + 1}") for i in range(8)], "parent string, child string")
    roots = spark.createDataFrame([("a",), ("n0",)], "root string")
    got = {(r.root, r.node): r.depth for r in catalog.lineage(e, roots).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "d"): 1, ("a", "c"): 2} | {("n0", f"n{i}"): i for i in range(6)}
    up = {r.node for r in catalog.lineage(e, spark.createDataFrame([("n2",)], "root string"), down=False).collect()}
    assert up == {"n0", "n1", "n2"}


def test_retention_and_archive(spark, tmp_path):
    rows = [(1, "delete_after_30_days", "ACTIVE", dt.date(2024, 1, 1), None, False), (2, "keep_forever", "ACTIVE", dt.date(2000, 1, 1), None, False), (3, "delete_after_90_days_if_failed", "ACTIVE", dt.date(2023, 1, 1), None, False), (4, "delete_after_90_days_if_failed", "ACTIVE", dt.date(2023, 1, 1), None, True), (5, "x", "DELETED", dt.date(2023, 1, 1), dt.date(2024, 1, 1), False)]
    df = spark.createDataFrame(rows, "id int, pol string, st string, c date, d date, failed boolean")
    got = {r.id: r.next_status for r in catalog.retention(df, "pol", "st", "c", "d", F.col("failed"), F.lit("2024-02-15")).collect()}
    assert got == {1: "DELETED", 2: "ACTIVE", 3: "ACTIVE", 4: "DELETED", 5: "PURGED"}
    left = catalog.archive(df, "c", F.lit("2024-02-15"), 90, str(tmp_path / "a"), ["pol"])
    assert [r.id for r in left.collect()] == [1] and spark.read.parquet(str(tmp_path / "a")).count() == 4


def test_settings_and_their_trace():
    s, t = config.resolve(kind="legal", playbook_name="tech", manual={"chunk_size": 500}, run={"chunk_overlap": 900})
    assert s == {"chunk_size": 500, "chunk_overlap": 499, "min_chunk_size": 200, "max_chunk_size": 2000, "strategy": "semantic"}
    assert t == {"chunk_size": "manual", "chunk_overlap": "guard", "min_chunk_size": "content_type", "max_chunk_size": "content_type", "strategy": "content_type"}
    assert config.resolve(kind="legal", confidence=0.1)[0]["strategy"] == "fixed_size" and config.resolve()[1]["chunk_size"] == "global"
    assert config.playbook("e-commerce").name == "ECOMMERCE" and config.playbook("none").name == "TECH" and config.hint("MEDICAL") == "medical"


def test_gates_fail_without_their_metric(spark):
    s = spark.createDataFrame([(0.9, 1.0), (0.9, None)], "answer_relevance double, groundedness double")
    a = evaluation.aggregates(s, ["answer_relevance", "groundedness"])
    got = {r.gate: r.passed for r in evaluation.gates(a, {}).collect()}
    assert got == {"groundedness_min": True, "answer_relevance_min": True, "citation_coverage_min": False, "refusal_correctness_min": False, "context_relevance_min": False}


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = ev.windowed(s, "1000 days").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((r.hour, r.event_type, r.n, round(r.value, 4)) for r in rows)
    assert key(spark.table("hours").collect()) == key(ev.windowed(e).collect())
    for n in (1, 2):
        ev.ingest(spark, str(tmp_path / "in"), "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == e.count(), n
    assert ev.sessions(e).agg(F.sum("n")).first()[0] == e.count()
