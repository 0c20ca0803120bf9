"""Tables merged when read: last write wins, crashes, two writers, compaction, vacuum."""

from __future__ import annotations

import os
import random

import pytest

from quillmark.sources import merge
from quillmark.sources.merge import MergeTable

ROW = "id long, v int, a array<double>"


@pytest.fixture
def at(spark, tmp_path):
    return MergeTable(spark, f"file://{tmp_path}/t", "id", buckets=4)


def put(t, rows, order=None):
    return t.upsert(t.spark.createDataFrame(rows, ROW), order)


def gone(t, ids):
    return t.delete(t.spark.createDataFrame([(i,) for i in ids], "id long"))


def held(t, version=None):
    return {r.id: r.v for r in t.read(version).collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_last_write_wins_over_random_changes(at):
    r = random.Random(3)
    want, seen = {}, []
    for step in range(7):
        if step % 3 == 2:
            ids = [r.choice([None, *range(60)]) for _ in range(12)]
            gone(at, ids)
            want = {k: v for k, v in want.items() if k not in ids}
        else:
            rows = {r.choice([None, *range(60)]): step * 100 + i for i in range(25)}
            put(at, [(k, v, [float(v)]) for k, v in rows.items()])
            want |= rows
        if step == 4:
            assert at.compact(least=2)
        seen.append(dict(want))
        assert held(at) == want
    assert at.compact(least=1) and at.pending() == {} and held(at) == want and at.compact(least=1) == []
    assert held(at, 1) == seen[0] and held(at, 2) == seen[1]


def test_one_row_of_a_key_in_a_batch(at):
    put(at, [(1, 5, None), (1, 9, None), (1, 7, [1.0]), (2, None, None)], "v")
    assert held(at) == {1: 9, 2: None}
    put(at, [(1, 1, None), (1, 1, None)])
    assert held(at) == {1: 1, 2: None}


def test_empty_batches_and_no_table(at):
    with pytest.raises(ValueError):
        at.read()
    assert gone(at, [1]) is None and at.versions() == [] and at.compact() == []
    put(at, [])
    assert held(at) == {} and at.versions() == [1]
    put(at, [(1, 1, [])])
    gone(at, [1, 2])
    assert held(at) == {} and at.compact(1) and held(at) == {}


def test_cost_of_a_change_follows_its_batch(at, tmp_path):
    put(at, [(i, i, [float(i)] * 64) for i in range(4000)])
    whole = size(tmp_path)
    put(at, [(1, -1, [0.0])])
    assert size(tmp_path) - whole < whole / 20 and held(at)[1] == -1 and len(held(at)) == 4000


def test_a_crash_leaves_the_version_before(at, monkeypatch):
    put(at, [(1, 1, None)])
    monkeypatch.setattr(at, "_commit", lambda change: (_ for _ in ()).throw(RuntimeError("lost")))
    for work in (lambda: put(at, [(1, 2, None)]), lambda: gone(at, [1]), lambda: at.compact(1)):
        with pytest.raises(RuntimeError):
            work()
    monkeypatch.undo()
    assert held(at) == {1: 1} and at.versions() == [1]
    put(at, [(2, 2, None)])
    assert held(at) == {1: 1, 2: 2}
    assert at.vacuum(hours=24) == 0 and at.vacuum(hours=-1) == 3 and held(at) == {1: 1, 2: 2}


def test_two_writers(at, monkeypatch):
    put(at, [(1, 1, None)])
    other = MergeTable(at.spark, at.path, "id", buckets=4)
    real, done = merge.json.dumps, []

    def slow(x, **k):  # the other one commits between this one's look and its rename
        if not done and isinstance(x, dict) and x.get("version") == 2:
            done.append(1)
            put(other, [(2, 2, None), (1, 7, None)])
        return real(x, **k)

    monkeypatch.setattr(merge.json, "dumps", slow)
    assert put(at, [(3, 3, None), (1, 8, None)]) == 3
    assert held(at) == {1: 8, 2: 2, 3: 3} and held(at, 2) == {1: 7, 2: 2}


def test_compaction_beside_a_writer(at, monkeypatch):
    put(at, [(i, i, None) for i in range(20)])
    real, done = at._write, []

    def slow(rows, n):
        out = real(rows, n)
        if not done:
            done.append(1)
            put(MergeTable(at.spark, at.path, "id", buckets=4), [(3, 33, None)])
        return out

    monkeypatch.setattr(at, "_write", slow)
    assert at.compact(1) == [0, 1, 2, 3]
    assert held(at)[3] == 33 and len(held(at)) == 20 and sum(at.pending().values()) == 1


def test_columns_may_come_but_not_change(at):
    put(at, [(1, 1, None)])
    at.upsert(at.spark.createDataFrame([(2, "x")], "id long, note string"))
    got = {r.id: (r.v, r.note) for r in at.read().collect()}
    assert got == {1: (1, None), 2: (None, "x")}
    with pytest.raises(ValueError):
        at.upsert(at.spark.createDataFrame([("a",)], "id string"))
    with pytest.raises(ValueError):
        at.upsert(at.spark.createDataFrame([(1, True)], "id long, _gone boolean"))


def test_vacuum_drops_old_versions(at):
    put(at, [(1, 1, None)])
    put(at, [(1, 2, None)])
    at.compact(1)
    assert at.vacuum(keep=1, hours=-1) == 2 and at.versions() == [3] and held(at) == {1: 2}
    with pytest.raises(ValueError):
        at.read(1)
