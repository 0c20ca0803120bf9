"""Selection of first rows, divergence of sources, collocations, and the join of shingle sets, against SQL and plain models."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import collocations, divergence, neardup, selection, setjoin

DATA = "/root/testdata/sf0.001"


def sql(text, docs=None, **change):
    c = duckdb.connect()
    if docs is None:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    else:
        c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
        if docs:
            c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", docs)
    for old, new in change.values():
        assert old in text
        text = text.replace(old, new)
    cur = c.execute(text)
    return sorted([tuple(r[i] for i in np.argsort([d[0] for d in cur.description])) for r in cur.fetchall()], key=repr)


def rows(df):
    return sorted([tuple(r[c] for c in sorted(df.columns)) for r in df.collect()], key=repr)


def plain(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


@pytest.mark.parametrize(("k", "enough"), [(5, 5), (50, 60)])
def test_first_rows_with_ties(spark, k, enough):
    rng = random.Random(3)
    data = [(g, rng.choice((0, 1, 7, 5000, (1 << 30) - 1)) if g != "tied" else 9, "x" * rng.randrange(4) + str(i) if g == "long" else f"é{i}" if i % 2 else f"t{i}") for g in ("a", "tied", "long", "few") for i in range(3 if g == "few" else 200)]
    got = selection.top_rows(spark.createDataFrame(data, "g string, v long, item string"), ["g"], [("v", 30)], "item", k, enough).collect()
    want = {(g, item, r) for g in ("a", "tied", "long", "few") for r, (_, v, item) in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2].encode()))[:k], 1)}
    assert {(r.g, r["item"], r["rank"]) for r in got} == want


def test_first_rows_of_equal_rows_and_none(spark):
    df = spark.createDataFrame([("a", 1, "same")] * 30 + [("a", 1, None)], "g string, v long, item string")
    got = selection.top_rows(df, ["g"], [("v", 30)], "item", 3, 3).collect()
    assert [(r["item"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(None, 1), ("same", 2), ("same", 3)]
    assert selection.top_rows(df.limit(0), ["g"], [("v", 30)], "item", 3, 3).count() == 0


def test_divergence_against_sql(spark):
    assert rows(divergence.op11_source_divergence(spark, DATA)) == sql(divergence.OP11_SQL)


def test_divergence_of_odd_rows(spark, nasty, none):
    got = rows(divergence.divergence(nasty, least_docs=2))
    assert got and got == sql(divergence.OP11_SQL, plain(nasty), least=(">= 30", ">= 2"))
    assert rows(divergence.divergence(nasty, least_docs=100)) == sql(divergence.OP11_SQL, plain(nasty), least=(">= 30", ">= 100"))
    assert divergence.divergence(none).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n, of, v = 9 * 10**14 + 7, 10**16 + 3, 10**9 + 1
    df = spark.createDataFrame([(n, of, v), (1, 0, 0)], "n long, o long, v long").select(divergence.share("n", "o", "v").alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (n + 5) // (of + 5 * v), None]


def test_pair_sums_in_small_blocks():
    rng = np.random.default_rng(1)
    n, terms = 300, 20
    term, source = rng.integers(0, terms, n), rng.integers(0, 9, n)
    _, at = np.unique(term * 9 + source, return_index=True)
    term, source = term[at], source[at]
    p, b = rng.integers(1, 1000, len(at)), rng.integers(1, 50, 9)[source]
    for most in (1, 50, 10**6):
        got = {}
        for x, y, v in divergence._pair_sums(source, term, p, b, most):
            for key in zip(x.tolist(), y.tolist(), v.tolist(), strict=True):
                got[key[:2]] = got.get(key[:2], 0) + key[2]
        want = {}
        for i in range(len(at)):
            for j in range(len(at)):
                if term[i] == term[j] and source[i] < source[j]:
                    key = (int(source[i]), int(source[j]))
                    want[key] = want.get(key, 0) + int(abs(p[i] - p[j]) - abs(p[i] - b[j]) - abs(p[j] - b[i]) + abs(b[i] - b[j]))
        assert got == want


def test_collocations_against_sql(spark):
    assert rows(collocations.op12_phrase_collocations(spark, DATA)) == sql(collocations.OP12_SQL)


def test_collocations_of_odd_rows(spark, nasty, none):
    got = rows(collocations.collocations(nasty, least=2).withColumn("rank", collocations.F.col("rank").cast("long")))
    assert got == sql(collocations.OP12_SQL, plain(nasty), least=(">= 30", ">= 2")) and len(got) == 11
    assert collocations.collocations(none).count() == 0


def test_a_full_table_of_bits_changes_nothing(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    want = rows(collocations.collocations(df, least=8))
    assert want and rows(collocations.collocations(df, least=8, bits=64)) == want


def test_long_texts_are_cut_between_pieces(spark):
    text = "a b c, a b d. " * 50
    df = spark.createDataFrame([("en", text), ("en", text)], "lang string, text string")
    for k in (1, 2, 3):
        want = {r.phrase: r.f for r in collocations.phrase_counts(df, k).collect()}
        assert {r.phrase: r.f for r in collocations.phrase_counts(df, k, most=40).collect()} == want


def test_join_against_sql(spark):
    assert rows(setjoin.op13_jaccard_join(spark, DATA)) == sql(setjoin.OP13_SQL)


def test_join_of_odd_rows(spark, nasty, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.n_equal) for r in setjoin.joined(nasty).collect()}
    assert {(1, 12, 1, 3), (7, 12, 1, 3), (1, 3, 1, 1), (2, 0, 2, None), (3, 0, 3, None), (None, 0, None, None), (5, 1, 5, 1), (6, 0, 6, None)} <= got
    assert len([r for r in got if r[0] is None]) == 2 and setjoin.joined(nasty).count() == 12 and setjoin.joined(none).count() == 0


def linked(texts, k, percent):
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("length", [(9, 40), (60, 260)])
def test_join_at_all_sizes(spark, length):
    rng = random.Random(sum(length))
    texts = []
    for f in range(12):
        base = [f"w{rng.randrange(40 if f % 3 else 4000)}" for _ in range(rng.randrange(*length))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 25))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice(([], [f"n{rng.randrange(9)}"], [w[at], f"n{rng.randrange(9)}"]))
            texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in setjoin.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == linked(texts, 3, 90)


def test_keys_of_linked_sets_meet():
    rng = random.Random(5)
    for _ in range(4000):
        x, y = rng.randrange(1, 3000), rng.randrange(1, 3000)
        y = x if rng.random() < 0.3 else min(y, x * 100 // 90 + 1) if rng.random() < 0.5 else y
        for shared in {min(x, y), min(x, y) * 95 // 100}:
            if 100 * shared >= 90 * (x + y - shared):
                assert shared >= setjoin.overlap(x, y, 90)
                common = set(setjoin.size_groups(x, 90)) & set(setjoin.size_groups(y, 90))
                assert any(x + y - 2 * shared < parts for _, parts in common), (x, y, shared)
                if x != y or shared < x:
                    assert setjoin.overlap(x, y, 90) in set(setjoin.subset_sizes(x, 90)) & set(setjoin.subset_sizes(y, 90))


def test_subsets_that_leave_nothing_out(spark):
    """Sets of 9 are linked with those of 10 that hold all of them."""
    sets = [(bytes([n]), list(range(n))) for n in range(1, 33)]
    keys = {(bytes(r.cls), r.key) for r in setjoin.subset_keys(spark.createDataFrame(sets, "cls binary, items array<bigint>"), 90).collect()}
    of = lambda n: {k for c, k in keys if c == bytes([n])}
    assert not of(8) and of(9) & of(10) and not of(9) & of(12)
    assert all(of(n) & of(n + 1) for n in range(9, 32))


def mapped(monkeypatch, make, batch):
    """The batches that a mapping's function gives for a batch, without Spark's own batching."""
    runs = []
    monkeypatch.setattr(setjoin, "arrow_map", lambda df, run, schema: runs.append(run))
    make()
    return list(runs[0](iter([batch])))


def test_keys_are_made_by_blocks_of_texts(spark, monkeypatch):
    """A few batches of rows for all texts of a batch, with the keys that each text has by itself."""
    rng = random.Random(13)
    texts = [None, "", " \n\t", "a", "A b", "a b c"] + [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    df = spark.createDataFrame([("",)], "text string")
    of = lambda some: [(c, k) for b in mapped(monkeypatch, lambda: setjoin.part_keys(df, 3, 90, "text"), pa.RecordBatch.from_pydict({"text": pa.array(some, pa.string())})) for c, k in zip(*[x.to_pylist() for x in b.columns], strict=True)]
    whole = mapped(monkeypatch, lambda: setjoin.part_keys(df, 3, 90, "text"), pa.RecordBatch.from_pydict({"text": texts}))
    assert len(whole) == 1 and of(texts) == [x for t in texts for x in of([t])]

    sets = [(bytes([i % 256, n]), sorted(rng.sample(range(1 << 40), n))) for i in range(300) for n in (9, 10, 14)]
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], pa.binary()), pa.array([s for _, s in some], pa.list_(pa.int64()))], ["cls", "items"])
    made = lambda some: mapped(monkeypatch, lambda: setjoin.subset_keys(df, 90), batch(some))
    rows_of = lambda bs: sorted((c, k) for b in bs for c, k in zip(*[x.to_pylist() for x in b.columns], strict=True))
    assert len(made(sets)) <= 6 and rows_of(made(sets)) == sorted(x for s in sets for x in rows_of(made([s])))


def test_loads_are_summed_by_blocks(spark, monkeypatch):
    """The counters, which are far more than a text's shingles, are gone through once for many texts."""
    calls, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or bincount(*a, **k))
    texts = [f"one two three {i} four" for i in range(500)] + [None, ""]
    df = spark.createDataFrame([("",)], "text string")
    runs = []
    monkeypatch.setattr(setjoin, "arrow_map", lambda x, run, schema: runs.append(run) or spark.createDataFrame([(0, 0)], "at bigint, n bigint"))
    setjoin.loads(df, 3, "text")
    (got,) = runs[0](iter([pa.RecordBatch.from_pydict({"text": texts})]))
    assert len(calls) == 1 and sum(got["n"].to_pylist()) == 500 * 3 and max(got["n"].to_pylist()) >= 500


@pytest.mark.parametrize("words", [1, 3, 7, 1 << 15])
def test_shingles_do_not_cross_texts(monkeypatch, words):
    """However texts fall into blocks, each has the shingles that it has by itself."""
    monkeypatch.setattr(neardup, "BLOCK_WORDS", words)
    texts = [b"a b c d", None, b"", b"c d", b"a", b"A B\x0bc\td", b" \n ", b"c d a b c d", b"a"]
    for k in (1, 2, 3, 5):
        got = [s.tolist() for s in neardup.shingles_of(texts, k)]
        assert got == [next(neardup.shingles_of([t], k)).tolist() for t in texts]
        w = [t.lower().split() if t else [] for t in texts]
        assert [len(s) for s in got] == [len({tuple(x[i : i + k]) for i in range(max(1, len(x) - k + 1))}) if x else 0 for x in w]
        assert got[0] == got[5] and got[4] == got[8] and all(s == sorted(set(s)) for s in got)


def test_small_sets_join_by_their_subsets(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "boundary", lambda *_: setjoin.MOST_LIGHT)
    w = [f"w{i}" for i in range(12)]
    docs = list(enumerate([" ".join(w[:11]), " ".join(w), "other " + " ".join(w[:11]), " ".join(w[:10])]))
    got = {r.doc_id: r.component_id for r in setjoin.joined(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(4)] == linked([t for _, t in docs], 3, 90)


def test_boundary_follows_cost():
    assert setjoin.boundary([(12, 10, 10**9), (25, 10, 10**9)], 90) >= 25
    assert setjoin.boundary([(12, 10, 10**9), (31, 10**6, 10)], 90) in range(12, 31)
    assert setjoin.boundary([], 90) == setjoin.MOST_LIGHT


def test_two_versions_meet_in_proportion(spark, monkeypatch, n=60):
    """Texts of a second version, which share their differences from the first version's lead, are one group and meet nothing."""
    rng = random.Random(9)
    a = [f"a{i}" for i in range(300)]
    b = a[:225] + [f"b{i}" for i in range(75)]
    docs = []
    for base in (a, b):
        for _ in range(n):
            w = list(base)
            w[rng.randrange(300)] = f"x{rng.randrange(10**9)}"
            docs.append(" ".join(w))
    met = []
    across = neardup.across

    def counted(*args):
        pairs, d = across(*args)
        met.append((pairs.count(), d.count()))
        return pairs, d

    monkeypatch.setattr(neardup, "across", counted)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 2, 80).collect()}
    assert set(got.values()) == {0, n} and all(p == 0 for p, _ in met)
