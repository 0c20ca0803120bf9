"""Near duplicates, substring dedup, decontamination."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import decontamination, neardup, substrings
from quillmark.llm.common import bit_table, table

DATA = "/root/testdata/sf0.001"


def sets_of(docs, k):
    out = {}
    for i, t in docs:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in (t or "").encode().decode().replace("\xa0", " ").split(" ")]
        w = b"\x00".join((t or "").encode().lower().split()).split(b"\x00") if (t or "").split() else []
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute_components(docs, k, percent=80):
    sets = sets_of(docs, k)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_groups_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()]
    want, sizes = brute_components(docs, 2)
    rows = neardup.op6_near_duplicates(spark, DATA).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == sizes and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def family(seed, n, edits, length=120):
    rng = random.Random(seed)
    base = [f"v{rng.randrange(4000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"n{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "edits"), [(2, 14), (2, 30), (5, 5)])
def test_large_family_of_near_copies(spark, k, edits):
    """Variants on either side of the limit: groups must be those of all pairs."""
    texts = family(1, 150, edits) + family(2, 40, edits) + ["a b", "a b", "A B", "", "lone"]
    docs = list(enumerate(texts))
    random.Random(3).shuffle(docs)
    want, _ = brute_components(docs, k)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), k=k)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_chain_is_one_group(spark):
    base = [f"c{i}" for i in range(100)]
    docs = [(i, " ".join([f"x{j}" for j in range(i * 4)] + base[i * 4 :])) for i in range(20)]
    want, _ = brute_components(docs, 2)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), k=2)
    assert {r.doc_id: r.component_id for r in got.collect()} == want and len(set(want.values())) == 1


def test_components_of_any_graph(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {a: find(a) for e in edges if e[0] != e[1] for a in e}


def test_verification_seldom_drops_a_link():
    looks = neardup.least_matches(0.8)
    rng = np.random.default_rng(1)
    m = rng.random((20000, neardup.HASHES)) < 0.8
    kept = np.ones(len(m), bool)
    for n, least in looks:
        kept &= m[:, :n].sum(axis=1) >= least
    assert kept.mean() > 0.9995
    assert all((rng.random((2000, neardup.HASHES)) < 0.3)[:, :n].sum(axis=1).mean() < least or n < 50 for n, least in looks)


def test_near_duplicates_of_odd_rows(nasty, none):
    rows = neardup.near_duplicates(nasty, k=2).collect()
    assert len(rows) == nasty.count()
    by = {r.doc_id: r for r in rows if r.doc_id not in (1, None)}
    assert by[7].component_id == 1 and not by[7].kept and by[2].component_id == 2 and by[2].n_shingles == 0 and by[5].n_shingles == 1
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_one(nasty)
    assert kept.columns == nasty.columns and sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 1, 2, 3, 4, 5, 6, 8]
    assert kept.filter("doc_id IS NULL").count() == 2


def test_rows_under_one_id_are_judged_by_themselves(spark):
    rng = random.Random(21)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a, "en"), (1, a, "de"), (1, a, "en"), (1, b, "en"), (2, b + " more", "en"), (3, c, "en"), (2, c, "en"), (4, "", "x"), (4, "", "x"), (None, a, "en")]
    got = sorted((r.doc_id or 0, r.text, r.lang) for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect())
    assert [g[:2] for g in got] == sorted([(0, a), (1, a), (1, b), (2, c), (4, ""), (4, "")])


def test_gear_equals_the_rolling_loop():
    data = np.frombuffer("Some bytes, é and 😀, to roll over. ".encode() * 9, np.uint8)
    h, want = 0, []
    for x in data:
        h = ((h << 1) + int(substrings.GEAR[x])) & 0xFFFFFFFF
        want.append(h)
    assert substrings.gear(data).tolist() == want


def test_cuts_cover_the_text_and_resist_insertions():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(10**6)}é" for _ in range(2000))
    raw = text.encode()
    ends = substrings.cuts(np.frombuffer(raw, np.uint8), 24, 256)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(raw) and sizes.max() <= 256 and all(s >= 24 for s in sizes[:-1])
    [raw[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]
    other = ("inserted words in front " + text).encode()
    cut = substrings.cuts(np.frombuffer(other, np.uint8), 24, 256)
    a = {raw[s:e] for s, e in zip([0, *ends], ends, strict=False)}
    b = {other[s:e] for s, e in zip([0, *cut], cut, strict=False)}
    assert len(a & b) > 0.95 * len(a)
    assert substrings.cuts(np.frombuffer(b"", np.uint8), 24, 256) == []
    assert substrings.cuts(np.frombuffer(b"a" * 1000, np.uint8), 24, 256)[-1] == 1000


@pytest.mark.parametrize("unit", ["Der ", "a", "ab", "é", "three words repeated, ", "a longer sentence that is repeated word by word over and over; "])
def test_periodic_runs_share_chunks_at_any_offset(unit):
    """Equal runs of one word or sentence, behind texts of other lengths, are cut into equal chunks."""
    rng = random.Random(12)
    run = unit * (400 // len(unit.encode()))
    seen = []
    for n in range(0, 60, 3):
        raw = (prose(rng, n) + " " + run + prose(rng, 20)).encode()
        ends = substrings.cuts(np.frombuffer(raw, np.uint8), 24, 256)
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(raw) and sizes.max() <= 256 and all(s >= 24 for s in sizes[:-1])
        seen.append({raw[s:e] for s, e in zip([0, *ends], ends, strict=False) if raw[s:e] in run.encode()})
    assert set.intersection(*seen)


def test_forced_cuts_follow_the_text():
    """A stretch without any cut by the hash, behind two texts of other lengths, gets the same cuts soon."""
    rng = random.Random(13)
    raw = np.frombuffer(prose(rng, 60_000).encode(), np.uint8)
    ends = np.flatnonzero((substrings.gear(raw) & substrings.MASK) == 0)
    gaps = [(a + 1, b) for a, b in zip(ends, ends[1:], strict=False) if b - a > 200]
    shared = 0
    for a, b in gaps:
        got = []
        for off in (33, 50):  # the first 32 bytes have hashes of fewer bytes
            part = raw[a + off : b]
            got.append({e + off for e in substrings.cuts(part, 24, 128)} - {b - a})
        shared += bool(got[0] & got[1])
    assert gaps and shared > 0.8 * len(gaps)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_shared_passages_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(4)
    passage = prose(rng, 60)
    docs = [(i, prose(rng, rng.randrange(50, 300))) for i in range(80)]
    docs += [(100 + i, prose(rng, rng.randrange(5, 90)) + " " + passage + " " + prose(rng, 40)) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = substrings.repeated_spans(df).collect()
    assert {r.doc_id for r in rows} == set(range(100, 120)) and {r.first_id for r in rows} == {100}
    texts = dict(docs)
    for r in rows:
        assert texts[r.doc_id][r.start : r.end].strip() in passage or len(texts[r.doc_id][r.start : r.end]) <= len(passage) + 2
    cut = {r.doc_id: r.text for r in substrings.cut_repeats(df).collect()}
    assert cut[100] == texts[100] and all(len(cut[i]) < len(texts[i]) - 100 for i in range(101, 120)) and all(cut[i] == texts[i] for i in range(80))


def test_passages_of_just_over_50_words_are_found_whole(spark):
    """Pairs with a passage of 51 words each: the span is the whole passage, whatever of it lies outside of whole chunks."""
    rng = random.Random(8)
    docs, passages = [], {}
    for i in range(150):
        passage = prose(rng, 51)
        for j in (2 * i, 2 * i + 1):
            front = prose(rng, rng.randrange(5, 60)) + " "
            docs.append((j, f"{front}{passage} {prose(rng, rng.randrange(5, 60))}"))
            passages[j] = (len(front), len(front) + len(passage))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    old = {r.doc_id for r in substrings.repeated_spans(df, whole=False).collect()}
    rows = substrings.repeated_spans(df).collect()
    found = {r.doc_id for r in rows}
    assert old < found and len(found) >= 0.98 * len(docs) > len(old), (len(old), len(found))
    covered = [r for r in rows if r.start <= passages[r.doc_id][0] and passages[r.doc_id][1] <= r.end]
    assert len(covered) >= 0.95 * len(rows)
    assert all(abs(r.start - passages[r.doc_id][0]) <= 40 and abs(r.end - passages[r.doc_id][1]) <= 40 and r.n_bytes == r.end - r.start for r in covered)


def test_shared_lengths_are_those_of_all_pairs(spark):
    """Sorted neighbours give what comparing each context with every other would, also across the ends of ranges."""
    rng = random.Random(9)
    contexts = [(i % 3, bytes(rng.choice(b"ab ") for _ in range(rng.randrange(1, 30)))) for i in range(400)]
    df = spark.createDataFrame([(d, d, False, bytearray(c), i) for i, (d, c) in enumerate(contexts)], "hi bigint, lo bigint, back boolean, ctx binary, place bigint")
    got = {(r.hi, r.h): r.bytes for r in substrings.shared_lengths(df.withColumn("h", F.xxhash64("ctx"))).collect()}
    keys = {(r.hi, bytes(r.ctx)): r.h for r in df.select("hi", "ctx", F.xxhash64("ctx").alias("h")).collect()}
    for i, (d, c) in enumerate(contexts):
        n = max(substrings.common(c, e) for j, (f, e) in enumerate(contexts) if j != i and f == d)
        assert got.get((d, keys[d, c]), 0) == substrings.whole_words(c, n, False)[0]


def test_equal_contexts_in_many_ranges(spark):
    """Places of one context are dealt over several ranges, and it is found once, shared as a whole; what is in one place alone is not."""
    rows = [(1, 1, False, bytearray(b"all the same words"), i) for i in range(3000)] + [(2, 1, False, bytearray(b"once"), 1), (2, 1, True, bytearray(b"once"), 2)]
    df = spark.createDataFrame(rows, "hi bigint, lo bigint, back boolean, ctx binary, place bigint").repartition(4)
    got = substrings.shared_lengths(df.withColumn("h", F.xxhash64("ctx")))
    assert [(r.hi, r.lo, r.back, r.bytes, r.points) for r in got.collect()] == [(1, 1, False, 18, 18)]


def test_chunks_of_one_place_are_not_shuffled(spark):
    """Only chunks that may be repeated leave the tasks, and a table of bits that is full loses none and adds none."""
    rng = random.Random(21)
    passage = prose(rng, 60)
    docs = [(i, prose(rng, 200)) for i in range(60)] + [(100 + i, f"{prose(rng, 30)} {passage} é{prose(rng, 30)}") for i in range(3)] + [(200, None), (201, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    keys = substrings.chunk_keys(df, "text", 24, 256).groupBy("h").agg(F.sum("n").alias("n"))
    assert keys.agg(F.sum("n")).first()[0] > 1000
    left = substrings.chunks(df, "doc_id", "text", 24, 256, bit_table(keys.filter("n > 1").select("h"), 1 << 20)).collect()
    assert {100, 101, 102} <= {r._d for r in left} and sum(len(r.c) for r in left) < 60
    for r in left:
        text = dict(docs)[r._d]
        for c in r.c:
            assert text.encode()[c.at : c.at + c.size].decode() == text[c.start : c.end]
    full, wide = (sorted(map(repr, substrings.repeated_chunks(df, "doc_id", "text", 24, 256, bits).collect())) for bits in (64, 1 << 20))
    assert full == wide and len(wide) == 3


def test_substrings_of_odd_rows(nasty, none):
    assert substrings.repeated_spans(none).count() == 0
    assert {r.doc_id for r in substrings.repeated_spans(nasty, min_bytes=32).collect()} <= {1, 4, 7}
    out = substrings.cut_repeats(nasty, min_bytes=32)
    assert out.count() == nasty.count() and out.columns == nasty.columns


def test_repeats_equal_brute_force_over_chunks(spark):
    docs = table(spark, DATA, "documents")
    places = {}
    for r in docs.collect():
        raw = r.text.encode()
        ends = substrings.cuts(np.frombuffer(raw, np.uint8), 24, 256)
        for a, b in zip([0, *ends], ends, strict=False):
            places.setdefault(raw[a:b], []).append((r.doc_id, len(raw[:a].decode()), len(raw[:b].decode())))
    want = sorted(p for v in places.values() if len(set(v)) > 1 for p in v)
    got = sorted((r.doc_id, r.start, r.end, r.n_chunks) for r in substrings.repeated_spans(docs, min_bytes=0).collect())
    cover = lambda spans: {(s[0], x) for s in spans for x in range(s[1], s[2])}
    assert cover(want) == cover(got) and sum(g[3] for g in got) == len(set(want))


def chunk_places(rows):
    """Places (row, start, end, code points) of each chunk; rows equal in id and text once."""
    out = {}
    for i, t in dict.fromkeys(rows):
        raw = (t or "").encode()
        ends = substrings.cuts(np.frombuffer(raw, np.uint8), 24, 256)
        for a, b in zip([0, *ends], ends, strict=False):
            out.setdefault(raw[a:b], []).append(((i, t), a, b, len(raw[:a].decode()), len(raw[:b].decode())))
    return out


def overlapping(seed, repeats=True):
    """Documents of passages that meet in changing neighbourhoods; ids that repeat, null ids, equal rows."""
    rng = random.Random(seed)
    passages = [prose(rng, rng.randrange(30, 90)) for _ in range(6)]
    rows = []
    for i in range(30):
        parts = [rng.choice(passages) if rng.random() < 0.6 else prose(rng, rng.randrange(1, 60)) for _ in range(rng.randrange(1, 6))]
        rows.append((rng.choice([i, i, i // 2, None]), " ".join(parts)))
    return rows + (rows[:5] + rows[:2] + [(3, None), (3, ""), (None, None)] if repeats else [])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_columns_of_spans_against_brute_force(spark, seed):
    rows = overlapping(seed)
    places = {c: p for c, p in chunk_places(rows).items() if len(p) > 1}
    by_row = {}
    for p in places.values():
        ids = [x[0][0] for x in p if x[0][0] is not None]
        for row, a, b, s, e in p:
            by_row.setdefault(row, []).append((a, b, s, e, min(ids, default=None), len(p)))
    want = []
    for row, marks in by_row.items():
        group = []
        for m in [*sorted(marks), (10**9, 0, 0, 0, None, 0)]:
            if group and group[-1][1] != m[0]:
                firsts = [g[4] for g in group if g[4] is not None]
                want.append((row[0], group[0][2], group[-1][3], len(group), group[-1][1] - group[0][0], min(firsts, default=None), max(g[5] for g in group)))
                group = []
            group.append(m)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substrings.repeated_spans(df, min_bytes=0).select("doc_id", "start", "end", "n_chunks", "n_bytes", "first_id", "n_copies").collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert want and sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_no_chunk_is_lost_by_cutting(spark, seed):
    """Every distinct chunk of any text is still whole in some text, and texts do get shorter."""
    rows = overlapping(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [(r.text or "").encode() for r in substrings.cut_repeats(df, min_bytes=48).collect()]
    assert len(out) == len(rows) and sum(map(len, out)) < 0.9 * sum(len((t or "").encode()) for _, t in rows)
    for chunk in chunk_places(rows):
        assert any(chunk in t for t in out)


def test_neighbours_that_were_first_in_different_texts(spark):
    rng = random.Random(7)
    x, m, a, b, y = (prose(rng, 80) for _ in range(5))
    df = spark.createDataFrame([(1, f"{x} {m} {b}"), (5, f"{a} {m} {b}"), (9, f"{a} {m} {y}")], "doc_id bigint, text string")
    out = {r.doc_id: r.text for r in substrings.cut_repeats(df).collect()}
    assert a[:400] in out[5] and a[60:300] not in out[9] and m[60:300] not in out[5] and m[60:300] not in out[9] and out[1] == f"{x} {m} {b}"
    rows = spark.createDataFrame([(1, a), (1, a), (2, x + " " + a)], "doc_id bigint, text string")
    assert {r.n_copies for r in substrings.repeated_spans(rows).collect()} == {2}


def test_leaks_equal_the_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = {(a, b, n, m, f) for a, b, n, m, _, f in c.execute(decontamination.OP7_SQL).fetchall()}
    got = {(r.doc_id, r.item_id, r.n_item_words, r.n_matched, r.first_word) for r in decontamination.op7_decontamination(spark, DATA).collect()}
    assert got == want and got


def test_leaks_with_exchanged_words(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randrange(15, 50))) for i in range(30)] + [(90, "five short words stand here"), (91, ""), (92, None), (93, "here"), (94, "in a row")]
    docs = [(i, prose(rng, 200)) for i in range(40)]
    for i, t in items[:30]:
        w = t.split()
        for j in rng.sample(range(len(w)), len(w) // 8):
            w[j] = "zz"
        docs.append((100 + i, prose(rng, 30) + " " + " ".join(w).upper() + " " + prose(rng, 30)))
    docs.append((200, "here are five short words stand here in a row"))
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.overlaps(d, b).collect()}
    assert got == {(100 + i, i) for i in range(30)} | {(200, 90)}
    assert {r.doc_id for r in decontamination.decontaminate(d, b).collect()} == set(range(40))


def test_places_far_apart_are_not_added_up(spark):
    rng = random.Random(11)
    item = prose(rng, 30).split()
    one, two = " ".join(item[:14]), " ".join(item[14:28])
    docs = [(1, f"{one} {prose(rng, 3000)} {two}"), (2, f"{one} {two} {prose(rng, 50)}"), (3, " ".join([*item[:14], "zz", *item[14:]])), (4, " ".join(item[:14]))]
    docs += [(5, "the " * 3000), (6, f"{two} {one}")]
    df, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item)), (2, "the"), (3, "the " * 30)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.first_word) for r in decontamination.overlaps(df, b).collect()}
    assert got == {(2, 1): (28, 0), (3, 1): (30, 0), (5, 3): (30, -2)}


def test_decontamination_of_odd_rows(spark, nasty, none):
    b = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river bank", "x"), (None, None, "y")], "item_id bigint, text string, words string")
    left = decontamination.decontaminate(nasty, b)
    assert left.columns == nasty.columns and left.count() == nasty.count() - 3
    assert decontamination.overlaps(none, b).count() == 0 and decontamination.overlaps(nasty, b.filter("false")).count() == 0
    assert decontamination.overlaps(nasty, b).filter(F.col("doc_id") == 7).first().overlap == 1.0
