"""Jaccard join of shingle sets: subsets of small sets are enumerated, inverted lists of large sets are scanned."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, small, table, written
from .neardup import _mixed, binaries, class_groups, leads_of, members_of, settled, shingles_of

#: Counters of the shingles' loads, which put them in order from the rarest on.
LOADS = 1 << 18
#: Largest set whose subsets are ever enumerated; beyond it they are over ten thousand.
MOST_LIGHT = 32
#: Shingles that are worked on at once.
BLOCK = 1 << 17
#: Bits of a set's parity table.
ODD = 1024
_P = np.uint64(0x9E3779B97F4A7C15)


def overlap(x: int, y: int, percent: int) -> int:
    """Shingles that sets of these sizes must share: 100 o >= percent (x + y - o)."""
    return -(-percent * (x + y) // (100 + percent))


def subset_sizes(size: int, percent: int) -> list[int]:
    """The overlaps that a set needs with sets of the sizes that it may be linked with, those of equal sets apart."""
    sizes = range(-(-percent * size // 100), 100 * size // percent + 1)
    return sorted({o for s in sizes if (o := overlap(size, s, percent)) <= min(s, size) and not o == s == size})


def blocks(sets: Iterable[np.ndarray], most: int = BLOCK) -> Iterator[list[np.ndarray]]:
    """The sets that aren't empty, in lists of about `most` shingles."""
    out, n = [], 0
    for s in sets:
        if len(s):
            out.append(s)
            n += len(s)
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out


def key_rows(cls: list[bytes], each: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Rows (cls, key): each class has its number of the keys, which follow one another."""
    rows = pa.array(cls, pa.binary()).take(pa.array(np.repeat(np.arange(len(cls)), each)))
    return pa.RecordBatch.from_arrays([rows, pa.array(keys.view(np.int64))], ["cls", "key"])


def loads(df: DataFrame, k: int, text: str, counters: int = LOADS) -> np.ndarray:
    """How many of df's sets have a shingle that falls to each counter: a fixed number of sums, made by task and then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for b in batches:
            for sets in blocks(shingles_of(binaries(b.column(0)), k)):  # a block's counters at once, as they are far more than a text's shingles
                total += np.bincount((np.concatenate(sets) % np.uint64(counters)).astype(np.int64), minlength=counters)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "n"])

    rows = arrow_map(df.select(F.col(text).cast("string")), run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row for each counter at most
    out = np.zeros(counters, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def prefixes(df: DataFrame, k: int, percent: int, load: Broadcast, id_col: str, text: str) -> DataFrame:
    """id, n_shingles, cls (digest of the whole set, null if empty), rare (the shingles of which two linked sets share one), scan (what their lists are estimated to hold), odd (parity table), items (the set, if it is small)."""
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_of = load.value
        usual = n_of.mean()
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for s in shingles_of(binaries(b.column(1)), k):
                if not len(s):
                    row = (0, None, None, None, None, None)
                else:
                    n = n_of[(s % np.uint64(len(n_of))).astype(np.int64)]
                    first = np.lexsort((s, n))[: len(s) - -(-percent * len(s) // 100) + 1]
                    odd = np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=ODD) & 1
                    row = (len(s), xxhash.xxh3_128_digest(s.tobytes()), s[first].view(np.int64), int(np.maximum(n[first] - usual, 1).sum()), np.packbits(odd.astype(np.uint8)).tobytes(), s.view(np.int64) if len(s) <= MOST_LIGHT else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [id_col, "n_shingles", "cls", "rare", "scan", "odd", "items"])

    return arrow_map(df.select(id_col, F.col(text).cast("string")), run, f"`{id_col}` {id_type}, n_shingles bigint, cls binary, rare array<bigint>, scan bigint, odd binary, items array<bigint>")


def boundary(by_size: list[tuple[int, int, int]], percent: int, most: int = MOST_LIGHT) -> int:
    """The size up to which sets are small, from (size, sets, what their lists hold) of sizes up to `most`.

    A small set costs its subsets, a large one its lists; small sets that may be linked with a large one cost both. The cheapest size is taken, the largest of several; 0 if there is nothing to gain."""
    light = {s: n * sum(math.comb(s, o) for o in subset_sizes(s, percent)) for s, n, _ in by_size}
    heavy = {s: scan for s, _, scan in by_size}
    cost = lambda x: sum(light[s] for s in light if s <= x) + sum(heavy[s] for s in heavy if 100 * s >= percent * (x + 1))
    return min(range(most, -1, -1), key=cost)


def subsets(sets: np.ndarray, percent: int) -> np.ndarray:
    """A hash of each subset of each size that a link needs: a row for each row of sets, which are equally large."""
    size, keys = sets.shape[1], []
    for o in subset_sizes(size, percent):
        out = np.array(list(itertools.combinations(range(size), size - o)), np.int64).reshape(math.comb(size, o), size - o)  # what is left out, which may be nothing
        own = _mixed(sets * _P + np.uint64(o))
        keys.append(_mixed(own.sum(axis=1, dtype=np.uint64)[:, None] - own[:, out].sum(axis=2, dtype=np.uint64) + np.uint64(o)))
    return np.concatenate(keys, axis=1) if keys else np.empty((len(sets), 0), np.uint64)


def subset_keys(sets: DataFrame, percent: int) -> DataFrame:
    """cls, key: a hash of each subset of each size that a link needs, from small sets (cls, items). Sets of one size are taken together, as many as give about BLOCK shingles left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by_size: dict[int, list[tuple[bytes, np.ndarray]]] = {}
            for c, items in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by_size.setdefault(len(items), []).append((c, items.values.to_numpy().view(np.uint64)))
            for size, same in by_size.items():
                step = max(1, BLOCK // max(1, sum(math.comb(size, o) * max(1, size - o) for o in subset_sizes(size, percent))))
                for i in range(0, len(same), step):
                    cls, rows = zip(*same[i : i + step], strict=True)
                    keys = subsets(np.stack(rows), percent)
                    if keys.size:
                        yield key_rows(cls, np.full(len(cls), keys.shape[1]), keys.ravel())

    return arrow_map(sets, run, "cls binary, key bigint")


def candidates(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The small sets (cls, items), and cls, first of the large ones in whose lists other sets were found, from all sets (cls, n_shingles, rare, scan, items, first)."""
    sums = sets.filter(F.col("n_shingles") <= MOST_LIGHT).groupBy("n_shingles").agg(F.count(F.lit(1)), F.sum("scan")).collect()  # a row for each size
    most = boundary([tuple(r) for r in sums], percent)
    light = sets.filter((F.col("n_shingles") <= most) & F.col("items").isNotNull()).select("cls", "items")
    lists = sets.filter(100 * F.col("n_shingles") >= percent * (most + 1)).select("cls", "first", F.explode("rare").alias("key"))
    shared = written(lists.groupBy("key").count().filter("count > 1").select("key"), "lists")
    return light, lists.join(small(shared), "key", "left_semi").select("cls", "first").distinct()


def size_groups(size: int, percent: int) -> list[tuple[int, int]]:
    """(group, parts) of the two groups that a set of this size is in.

    Sizes are cut into bands, each as wide as a link allows; group i is for links of a set in band i with one in band i or i + 1. If such sets are linked, they
    differ in fewer shingles than the group has parts."""
    band, low, before = 0, 1, None
    while True:
        top = 100 * low // percent
        parts = (100 - percent) * (top + 100 * top // percent) // (100 + percent) + 1
        if size <= top:
            return [(band, parts)] + ([before] if before else [])
        band, low, before = band + 1, top + 1, (band, parts)


def parts_of(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many parts each of the sets has in its size groups, and their keys, set by set."""
    groups = [size_groups(len(s), percent) for s in sets]
    copies = [s for s, g in zip(sets, groups, strict=True) for _ in g]  # each set once for each of its groups
    sizes = np.array([len(s) for s in copies])
    group, parts = np.array([x for g in groups for x in g], np.uint64).T
    s = np.concatenate(copies)
    first = np.cumsum(parts, dtype=np.uint64) - parts  # where a copy's parts start
    width = np.uint64((1 << 64) - 1) // parts
    at = np.minimum(s // np.repeat(width, sizes), np.repeat(parts - np.uint64(1), sizes)) + np.repeat(first, sizes)
    own = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(s * _P), dtype=np.uint64)])
    ends = own[np.concatenate([[0], np.cumsum(np.bincount(at.astype(np.int64), minlength=int(parts.sum())))])]
    each = parts.astype(np.int64)
    nth = np.arange(each.sum(), dtype=np.uint64) - np.repeat(first, each)
    keys = _mixed(_mixed(ends[1:] - ends[:-1]) + nth * _P + np.repeat(group, each))
    return np.array([sum(n for _, n in g) for g in groups]), keys


def part_keys(df: DataFrame, k: int, percent: int, text: str) -> DataFrame:
    """cls, key of each part of each text's set: the range of hashes is cut into the parts of the set's size groups. Two linked sets have an equal part, as they differ in fewer shingles than there are parts; sets that only share a passage have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sets in blocks(shingles_of(binaries(b.column(0)), k)):
                each, keys = parts_of(sets, percent)
                yield key_rows([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], each, keys)

    return arrow_map(df.select(F.col(text).cast("string")), run, "cls binary, key bigint")


def with_sizes(pairs: DataFrame, sets: DataFrame, percent: int, keep: tuple[str, ...]) -> DataFrame:
    """Pairs of nodes (a, b) as (a, b, *keep, live): live unless their sizes, or the bits in which their parity tables differ, rule a link out.

    Each shingle that only one of both sets has turns one bit, so at least as many shingles differ as bits do. Repeated pairs are judged alike."""
    cls = lambda c: F.substring(c, 6, 16)
    x = pairs.withColumn("_ca", cls("a")).withColumn("_cb", cls("b"))
    for side in ("a", "b"):
        x = x.join(sets.select(F.col("cls").alias(f"_c{side}"), F.col("n_shingles").alias(f"n{side}"), F.col("odd").alias(f"o{side}")), f"_c{side}")
    types = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = (b.column(i).to_numpy() for i in (2, 3))
            oa, ob = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (4, 5))
            differ = np.bitwise_count(oa ^ ob).sum(axis=1).astype(np.int64)
            live = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * differ <= (100 - percent) * (na + nb))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *b.columns[6:], pa.array(live)], ["a", "b", *keep, "live"])

    schema = ", ".join(f"{c} {types[c]}" for c in ("a", "b", *keep))
    return arrow_map(x.select("a", "b", "na", "nb", "oa", "ob", *keep), run, f"{schema}, live boolean")


def joined(df: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row of df: id, n_shingles, component_id (the least id that links reach, its own included), n_equal (rows with an id and the same set, itself included).

    Two sets are linked if 100 x shared >= percent x all of their shingles. Equal sets are one class. Up to a size that is chosen by cost (`boundary`), all subsets of the sizes that a
    link needs are enumerated, and two linked sets have one in common. Larger sets, and small ones that may be linked with them, are in the inverted lists of their rarest shingles: as
    many that two linked sets must share one. Rareness comes from a fixed number of counters over all sets; any order gives the same links. Lists also hold texts that only share a passage, so
    their sets meet on equal parts (`part_keys`), which linked sets must have too. Then a bucket's lead is compared with its members, and members left in other groups by
    their differences from the lead (`neardup.across`). All are confirmed on whole sets, so groups are those of an exact join over 64-bit shingle hashes.

    Nulls: null and empty texts have no shingles and stay by themselves, n_equal null; a null id stays by itself, with component_id null. Rows that repeat an id are
    judged by their own text. An empty table gives an empty result. Columns of df other than the id and the text have no effect.
    """
    load = df.sparkSession.sparkContext.broadcast(loads(df, k, text))
    found = written(prefixes(df, k, percent, load, id_col, text), "prefixes")
    load.unpersist()
    known = found.filter(F.col(id_col).isNotNull() & F.col("cls").isNotNull())
    same = ["n_shingles", "rare", "scan", "odd", "items"]
    sets = known.groupBy("cls").agg(*[F.first(c).alias(c) for c in same], F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n_equal"))
    sets = written(sets, "classes")
    light, large = candidates(sets, percent)
    texts = df.select(id_col, text).join(small(written(large.select(F.col("first").alias(id_col)), "ids")), id_col, "left_semi")
    keys = written(subset_keys(light, percent).unionByName(part_keys(texts, k, percent, text)), "keys")
    members = written(members_of(keys), "members")
    roots = None
    if not members.isEmpty():
        pairs = written(with_sizes(leads_of(members), sets, percent, ("n",)).filter("live OR n > 2"), "pairs")
        roots = settled(df, sets, pairs, k, percent, id_col, text, lambda x: with_sizes(x, sets, percent, ("lead",)).filter("live"))
    classes = class_groups(sets, roots).join(sets.select("cls", "n_equal"), "cls")
    out = found.select(id_col, "n_shingles", "cls").join(classes, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col(id_col)).when(F.col(id_col).isNotNull(), F.col("least"))
    return out.select(id_col, "n_shingles", component.alias("component_id"), F.when(F.col(id_col).isNotNull(), F.col("n_equal")).alias("n_equal"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by links of 3-word shingles at 90 %."""
    return joined(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS g FROM w, unnest(range(1, greatest(len(w) - 1, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, list(g ORDER BY g) AS items FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS root, doc_id AS node FROM w UNION SELECT r.root, e.y FROM r JOIN e ON e.x = r.node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, CASE WHEN n.n > 0 THEN count(*) OVER (PARTITION BY n.items) END AS n_equal
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT root, min(node) AS c FROM r GROUP BY root) m ON m.root = w.doc_id
"""
