"""Sharding, mixing and training order."""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmark.llm import mixing, sharding, training_order
from quillmark.llm.tokens import RANKS, encoder

DATA = "/root/testdata/sf0.001"


def k60(*parts):
    return int(hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def test_shards_hold_their_share(spark):
    rows = sharding.op1_sharding(spark, DATA).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = sorted(map(len, by.values()))
    assert len(by) == 8 and sizes[-1] - sizes[0] <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    n = Counter(r.source for r in rows)
    for v in by.values():
        for s, c in Counter(r.source for r in v).items():
            assert abs(c - n[s] / 8) <= 2


def test_shards_equal_a_plain_model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").collect()
    strata = defaultdict(list)
    for d in docs:
        strata[d.source].append(d.doc_id)
    order = []
    for s, ids in strata.items():
        ids.sort(key=lambda i: (k60("shard-1", i), i))
        order += [((2 * r + 1) / (2.0 * len(ids)), "0" + s, r, i) for r, i in enumerate(ids)]
    order.sort()
    want = {i: p * 8 // len(order) for p, (_, _, _, i) in enumerate(order)}
    assert {r.doc_id: r.shard for r in sharding.op1_sharding(spark, DATA).collect()} == want


def test_sharding_of_odd_rows(nasty, none):
    out = sharding.interleave(nasty)
    assert out.columns.count("shard") == 1 and out.count() == nasty.count()
    slots = defaultdict(list)
    for r in out.select("shard", "slot").collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.interleave(none).count() == 0


@pytest.mark.parametrize("of", [lambda i: f"s{i}", lambda i: f"s{i // 2}" if i < 2000 else "hot"])
def test_many_small_strata(spark, of):
    """A stratum for each row, or pairs beside a large one, with a third of the ids missing: the order is that of a plain model."""
    rows = [(None if i % 3 == 0 else i, of(i), i) for i in range(3000)]
    out = sharding.places(spark.createDataFrame(rows, "doc_id bigint, s string, _q_t bigint").withColumn("_q_s", F.concat(F.lit("0"), "s")).drop("s"), 8, "doc_id", "x").collect()
    strata = defaultdict(list)
    for d, s, t in rows:
        strata["0" + s].append((k60("x", d if d is not None else f"#{t}"), d is not None, d or 0, t))
    order = sorted(((2 * r + 1) / (2.0 * len(v)), s, r, x[3]) for s, v in strata.items() for r, x in enumerate(sorted(v)))
    first = [-(-k * len(rows) // 8) for k in range(8)]
    assert {r["_q_t"]: (r.shard, r.slot) for r in out} == {t: (p * 8 // len(rows), p - first[p * 8 // len(rows)]) for p, (_, _, _, t) in enumerate(order)}


def test_no_range_holds_all_small_strata(spark):
    """Rows of equal fractions are sorted in many ranges: none holds more than twice its share."""
    x = spark.range(40000).select(F.col("id").alias("doc_id"), F.concat(F.lit("0"), F.col("id").cast("string")).alias("_q_s"), F.col("id").alias("_q_t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = sharding.places(x, 8, "doc_id", "x").inputFiles()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [pq.read_metadata(f.removeprefix("file://")).num_rows for f in files]
    assert sum(sizes) == 40000 and len(sizes) == 4 and max(sizes) <= 20000


def test_written_shards_are_in_order(spark, tmp_path):
    sharding.write_shards(sharding.interleave(spark.read.parquet(f"{DATA}/documents.parquet")), str(tmp_path / "s"))
    files = sorted((tmp_path / "s").glob("shard=*/*.parquet"))
    slots = defaultdict(list)
    for f in files:
        slots[f.parent.name].append(pq.read_table(f, partitioning=None).column("slot").to_pylist())
    assert len(slots) == 8 and all(x == sorted(x) for v in slots.values() for x in v) and sum(len(x) for v in slots.values() for x in v) == 200


def test_mix_meets_targets(spark):
    rows = mixing.op5_mixing(spark, DATA).collect()
    taken, target, size = Counter(), {}, {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert len([s for s in r.mix_shards.split(",") if s]) == (r.taken // r.size if r.size else 0)
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= largest / 2 + 1 and target[s] <= 3 * size[s] + 1e-6 for s in target)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3
    again = {r.doc_id: (r.taken, r.mix_shards) for r in mixing.op5_mixing(spark, DATA).collect()}
    assert again == {r.doc_id: (r.taken, r.mix_shards) for r in rows}


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 1, 1], [1, 1000, 5, 7], [0, 10, 20], [5], [0, 0]])
def test_targets_by_repeated_sharing(spark, sizes):
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    total, cap = sum(sizes), [3.0 * s for s in sizes]
    want, live = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while live:
        share = {i: left * w[i] / sum(w[j] for j in live) for i in live}
        over = [i for i in live if share[i] > cap[i] + 1e-12]
        if not over:
            for i in live:
                want[i] = share[i]
            break
        for i in over:
            want[i] = cap[i]
            left -= cap[i]
            live.remove(i)
    df = spark.createDataFrame([(f"0s{i}", s) for i, s in enumerate(sizes)], "_q_s string, source_size bigint")
    got = {r["_q_s"]: r.target for r in mixing.targets(df).collect()}
    assert [got[f"0s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def quotas(spark, sizes, n_shards, seed, group=1024):
    df = spark.createDataFrame([(f"0s{i}", q) for i, q in enumerate(sizes)], "_q_s string, q bigint")
    return {(r["_q_s"], r.mix_shard): r.q for r in mixing.split_tree(df, n_shards, seed, group).collect()}


@pytest.mark.parametrize(("sizes", "n_shards", "group"), [([100, 3, 40], 8, 1024), ([1], 4, 1024), ([5, 5, 5, 5, 5, 5, 5], 3, 2), ([50, 0, 7], 1, 1024), ([30] * 9, 8, 2)])
def test_splitting_tree_deals_every_block(spark, sizes, n_shards, group):
    got = quotas(spark, sizes, n_shards, "x", group)
    for i, q in enumerate(sizes):
        assert sum(v for (s, _), v in got.items() if s == f"0s{i}") == q
    per = Counter()
    for (_, k), v in got.items():
        per[k] += v
    assert set(per) <= set(range(n_shards)) and max(per.values()) - min(per.get(k, 0) for k in range(n_shards)) <= 3
    if group == 2:
        assert got == quotas(spark, sizes, n_shards, "x", group)


def test_quotas_have_the_law_of_random_draws(spark):
    """Over many nodes with seeds of their own, means and variances are those of draws without replacement, and sources depend on each other as they must."""
    sizes, runs = (12, 5, 23), 3000
    n, d = sum(sizes), sum(sizes) // 2
    df = spark.range(runs).select(F.col("id").cast("string").alias("seed"), F.array(*[F.struct(F.lit(f"s{i}").alias("k"), F.lit(q).cast("long").alias("q")) for i, q in enumerate(sizes)]).alias("m"))
    rows = np.array([[e.x for e in r.e] for r in df.select(mixing.drawn(F.col("m"), F.lit(n).cast("long"), F.lit(d).cast("long"), F.col("seed")).alias("e")).collect()])
    assert (rows.sum(axis=1) == d).all() and (rows <= sizes).all() and (rows >= 0).all()
    p = np.array(sizes) / n
    cov = d * (n - d) / (n - 1) * (np.diag(p) - np.outer(p, p))
    assert np.abs(rows.mean(axis=0) - d * p).max() < 5 * np.sqrt(cov.max() / runs)
    assert np.abs(np.cov(rows.T) - cov).max() < 0.08 * cov.max() + 0.05


@pytest.mark.parametrize(("n", "k", "d"), [(10, 4, 5), (100, 1, 50), (7, 7, 3), (7, 0, 3), (9, 5, 0), (9, 5, 9), (2_000_000, 900_000, 1_000_000)])
def test_hypergeometric_by_its_terms(spark, n, k, d):
    """The draw at u is where the sums of the terms, from the mode upwards, then downwards, go beyond u."""
    us = [0.0, 1e-9, 0.1, 0.3, 0.5, 0.777, 0.95, 1 - 1e-12]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    c = lambda v: F.lit(v).cast("long")
    got = [r.x for r in df.select(mixing.hypergeometric(c(n), c(k), c(d), F.col("u")).alias("x")).collect()]
    lg = math.lgamma
    low, high = max(0, d + k - n), min(k, d)
    mode = min(high, max(low, (d + 1) * (k + 1) // (n + 2)))
    log = lambda x: -(lg(x + 1) + lg(k - x + 1) + lg(d - x + 1) + lg(n - k - d + x + 1))
    xs = [*range(mode, min(high, mode + 9000) + 1), *range(mode - 1, max(low, mode - 9000) - 1, -1)]
    ws = np.cumsum([math.exp(log(x) - log(mode)) for x in xs])
    for u, x in zip(us, got, strict=True):
        want = xs[min(len(xs) - 1, int((ws <= u * ws[-1]).sum()))]
        assert x == want or (n > 1000 and abs(x - want) <= 1), (u, x, want)


def test_mix_of_odd_rows(nasty, none):
    out = mixing.mix(nasty)
    assert out.columns.count("size") == 1 and {r.size for r in out.collect()} >= {1}
    narrow = nasty.select("doc_id", "source", mixing.words().alias("size"))
    assert mixing.placements(narrow, unused=True).select("_q_s", "_rank").distinct().count() == nasty.count()
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(nasty.withColumn("_q_s", F.lit(1)))


def test_mix_carries_whole_rows(spark, nasty):
    """Each copy has all columns of its row, equal rows are taken as often as they occur, and written shards hold them all."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    rows = mixing.mix(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id] == r.text and r.m == {"k": r.doc_id} for r in rows)
    narrow = mixing.placements(docs.select("doc_id", "source", mixing.words().alias("size"))).collect()
    assert Counter((r.doc_id, r["copy"], r.mix_shard) for r in rows) == Counter((r.doc_id, r["copy"], r.mix_shard) for r in narrow)


def test_written_mix_is_in_order(spark, tmp_path):
    out = mixing.mix(spark.read.parquet(f"{DATA}/documents.parquet"))
    mixing.write_mix(out, str(tmp_path / "m"))
    seen = defaultdict(list)
    for f in sorted((tmp_path / "m").glob("mix_shard=*/*.parquet")):
        order = pq.read_table(f, partitioning=None).column("mix_order").to_pylist()
        assert order == sorted(order)
        seen[int(f.parent.name.split("=")[1])] += order
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(r.mix_order for r in out.collect() if r.mix_shard == k) for k in seen}


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 255, 256, 257, 5000):
        assert sorted(training_order.feistel(np.arange(n), n)) == list(range(n))
    assert (training_order.feistel(np.arange(1000), 1000) != training_order.feistel(np.arange(1000), 1000, key=1)).any()


def test_training_order_round_trip(spark, nasty, none, tmp_path):
    path = f"file://{tmp_path}/order"
    rows = training_order.materialise(nasty, path, seq_len=64, shard_bytes=128 * 100).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    read = list(training_order.read_from(path))
    assert len(read) == len(rows) and len({r.shard for r in rows}) > 5
    half = len(rows) // 2
    assert [x.tolist() for x in training_order.read_from(path, half, 10)] == [x.tolist() for x in read[half : half + 10]]
    assert list(training_order.read_from(path, len(rows), 5)) == [] and len(list(training_order.read_from(path, len(rows) - 2, 5))) == 2
    for r in rows[::7]:
        with open(tmp_path / "order" / f"shard-{r.shard:08d}.bin", "rb") as f:
            f.seek(r.offset)
            assert zlib.crc32(f.read(128)[: 2 * r.n_tokens]) == r.crc32
    assert not [p for p in (tmp_path / "order").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    encode = encoder(open(RANKS, "rb").read()).encode_ordinary
    texts = Counter((r.doc_id, r.text) for r in nasty.collect() if r.text)
    parts = Counter()
    for r, x in zip(rows, read, strict=True):
        assert (x[r.n_tokens :] == 50256).all()
        parts[(r.doc_id, r.seq_no, tuple(x[: r.n_tokens].tolist()))] += 1
    want = Counter()
    for (i, t), c in texts.items():
        ids = [*encode(t), 50256]
        for s in range(0, len(ids), 64):
            want[(i, s // 64, tuple(ids[s : s + 64]))] += c
    assert parts == want
    assert training_order.materialise(none, path + "0").count() == 0 and list(training_order.read_from(path + "0")) == []


def test_slots_follow_the_keyed_order(spark, tmp_path):
    """A plain model: places by the seeded order of the ids and the texts' bytes, permuted, ranked among those in use."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if r.text]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.seq_no): r.slot for r in training_order.materialise(df, f"file://{tmp_path}/o", seq_len=128, shard_bytes=1 << 16).collect()}
    encode = encoder(open(RANKS, "rb").read()).encode_ordinary
    base, places = 0, []
    for i, t in sorted(docs, key=lambda d: (k60(training_order.KEY, d[0]), d[0])):
        places += [(base + s, i, s) for s in range(-(-(len(encode(t)) + 1) // 128))]
        base += -(-(len(t.encode()) + 1) // 128)
    order = np.argsort(training_order.feistel(np.array([p[0] for p in places]), base))
    assert got == {(places[j][1], places[j][2]): slot for slot, j in enumerate(order)}


def test_larger_vocabularies_take_wider_ids(spark, tmp_path):
    lines = open(RANKS, "rb").read().splitlines()
    (tmp_path / "ranks").write_bytes(b"\n".join([*lines, base64.b64encode(b" never seen in any text") + b" 70000"]))
    df = spark.createDataFrame([(1, "some words to be cut")], "doc_id bigint, text string")
    training_order.materialise(df, f"file://{tmp_path}/o", seq_len=16, ranks=str(tmp_path / "ranks")).collect()
    (only,) = training_order.read_from(f"file://{tmp_path}/o")
    assert only.dtype.itemsize == 4 and only[-1] == 70001


def test_many_equal_rows_are_each_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "the same words")] * 2500 + [(2, "others"), (2, "others"), (2, "more")], "doc_id bigint, text string")
    rows = training_order.materialise(df, f"file://{tmp_path}/o", seq_len=16).collect()
    assert Counter(r.doc_id for r in rows) == {1: 2500, 2: 3} and sorted(r.slot for r in rows) == list(range(2503))
