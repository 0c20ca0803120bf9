"""MinHash near-duplicates with sequential Bayesian verification, and the groups that links make."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, refuse, row_hash, small, table, written

BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Words that are hashed at once.
BLOCK_WORDS = 1 << 15
#: Chance that verification drops a pair at the least similarity, at each look at the signatures.
MISS = 1e-6
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_BAND = _RNG.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def _windows(h: np.ndarray, width: int) -> np.ndarray:
    s = np.full(len(h) - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        s = _mixed(s * _P + h[j : len(h) - width + 1 + j])
    return s


def _distinct(s: np.ndarray) -> np.ndarray:
    """np.unique by a sort alone, which is several times faster than by its hash table."""
    s = np.sort(s)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def shingles_of(texts: Iterable[bytes | None], k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles in turn, as sorted 64-bit hashes.

    A-Z are lower-cased and ASCII white space alone separates words; with 1 to k - 1 words the whole
    sequence is the one shingle; without words, or for a null text, there is none. Words are hashed by blocks of texts, as most texts are too short for arrays of their own.
    """
    block, sizes = [], []
    for t in texts:
        words = t.lower().split() if t is not None else []
        block += words
        sizes.append(len(words))
        if len(block) >= BLOCK_WORDS:
            yield from _block_shingles(block, sizes, k)
            block, sizes = [], []
    yield from _block_shingles(block, sizes, k)


def _block_shingles(block: list[bytes], sizes: list[int], k: int) -> Iterator[np.ndarray]:
    h, at = _hashes(block), 0
    s = _windows(h, k) if len(h) >= k else h[:0]
    for n in sizes:
        yield _distinct(s[at : at + n - k + 1] if n >= k else _windows(h[at : at + n], n) if n else h[:0])
        at += n


def binaries(col: pa.Array) -> Iterator[bytes | None]:
    """Each text of a column of strings as its bytes."""
    return (t.as_buffer().to_pybytes() if t.is_valid else None for t in col.cast(pa.binary()))


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles, in blocks so that a long text takes little memory."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(least, (s[i : i + 1024, None] * _A + _B).min(axis=0), out=least)
    return least >> np.uint64(32)


def signatures(df: DataFrame, k: int, id_col: str, text: str) -> DataFrame:
    """id, t (hash of id and text), n_shingles, cls (128-bit digest of the whole set, null if empty), bands (one 64-bit key each), sig (a byte of each hash)."""
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, cls, bands, sigs = [], [], [], []
            for s in shingles_of(binaries(b.column(2)), k):
                sizes.append(len(s))
                if not len(s):
                    cls.append(None), bands.append(None), sigs.append(None)
                    continue
                v = signature(s)
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(_mixed((v.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _P).view(np.int64))
                sigs.append(v.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(sizes, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], [id_col, "t", "n_shingles", "cls", "bands", "sig"])

    return arrow_map(df.select(id_col, F.xxhash64(id_col, text), F.col(text).cast("string")), run, f"`{id_col}` {id_type}, t bigint, n_shingles bigint, cls binary, bands array<bigint>, sig binary")


def shingle_sets(df: DataFrame, k: int, text: str) -> DataFrame:
    """cls and its whole set, from texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingles_of(binaries(b.column(0)), k))
            for i in range(0, len(sets), 64):  # small batches, as the sets may be larger than the texts
                part = sets[i : i + 64]
                cls = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in part], pa.binary())
                yield pa.RecordBatch.from_arrays([cls, pa.array([s.view(np.int64) for s in part], pa.list_(pa.int64()))], ["cls", "items"])

    return arrow_map(df.select(text), run, "cls binary, items array<bigint>")


def least_matches(similarity: float, miss: float = MISS, step: int = BANDS) -> list[tuple[int, int]]:
    """(hashes looked at, matches that a pair needs to stay) for each look.

    The prior of the similarity is uniform. A byte of a hash also matches by chance, so a pair of similarity s matches
    with chance s + (1 - s) / 256 in each; given m matches of n, that chance has the posterior Beta(m + 1, n - m + 1), and a
    pair leaves once the chance that its similarity is at least `similarity` is below `miss`.
    """
    limit = similarity + (1 - similarity) / 256

    def above(m: int, n: int) -> float:  # P(Beta(m + 1, n - m + 1) > limit), a binomial sum
        return sum(math.comb(n + 1, i) * limit**i * (1 - limit) ** (n + 1 - i) for i in range(m + 1))

    return [(n, next(m for m in range(n + 1) if above(m, n) >= miss)) for n in range(step, HASHES + 1, step)]


def likely(pairs: DataFrame, percent: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b, sa, sb, and the columns `keep`) as (a, b, *keep, live): live if sequential verification leaves the pair.

    Batches of the signatures sa and sb are compared one after the other, and a pair leaves at the first look that makes it too unlikely. Null
    signatures can't be compared and must not come here (classes without shingles have none and are in no bucket). Repeated pairs are judged alike; no pairs give no rows.
    """
    looks = least_matches(percent / 100)
    types = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3))
            left, matches, seen = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64), 0
            for n, least in looks:
                matches[left] += (x[left, seen:n] == y[left, seen:n]).sum(axis=1)
                left, seen = left[matches[left] >= least], n
            live = np.zeros(b.num_rows, bool)
            live[left] = True
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *b.columns[4:], pa.array(live)], ["a", "b", *keep, "live"])

    schema = ", ".join([f"{c} {types[c]}" for c in ("a", "b", *keep)])
    return arrow_map(pairs.select("a", "b", "sa", "sb", *keep), run, f"{schema}, live boolean")


def with_signatures(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs of nodes (a, b) with their signatures sa and sb."""
    cls = lambda c: F.substring(c, 6, 16)
    x = pairs.withColumn("_ca", cls("a")).withColumn("_cb", cls("b"))
    return x.join(sigs.select(F.col("cls").alias("_cb"), F.col("sig").alias("sb")), "_cb").join(sigs.select(F.col("cls").alias("_ca"), F.col("sig").alias("sa")), "_ca")


def differences(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """lead, node, n, linked, w, d of pairs (a: lead, b: node, n): d are the shingles that only one of both sets has, ascending; kept if n > 2.

    Two sets share (|x| + |y| - |d|) / 2 shingles, so they are linked if w, (100 + percent) |d| - (100 - percent) |x|, is at most
    (100 - percent) |lead|. w also serves to compare two nodes of one lead, see `across`.
    """
    sets = sets.dropDuplicates(["node"])
    leads = sets.join(small(pairs.select(F.col("a").alias("node")).distinct()), "node", "left_semi")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("ib")), "b").join(leads.select(F.col("node").alias("a"), F.col("items").alias("ia")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked, ws, ds = [], [], []
            for i, n in enumerate(b.column(2).to_pylist()):
                x, y = (b.column(j)[i].values.to_numpy() for j in (3, 4))
                d = np.setxor1d(x, y, assume_unique=True)
                w = (100 + percent) * len(d) - (100 - percent) * len(y)
                ws.append(w), linked.append(w <= (100 - percent) * len(x)), ds.append(d if n > 2 else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(linked, pa.bool_()), pa.array(ws, pa.int64()), pa.array(ds, pa.list_(pa.int64()))], ["lead", "node", "n", "linked", "w", "d"])

    return arrow_map(both.select("a", "b", "n", "ia", "ib"), run, "lead binary, node binary, n bigint, linked boolean, w bigint, d array<bigint>")


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """node, root for every node of edges (a, b): the least node that it reaches.

    Alternating stars: each node's larger neighbours, then its smaller ones, are tied to the least node that it sees, until all edges form
    stars. That takes rounds in the order of the logarithm of the longest path; least nodes are found by sums made before the shuffle, so a hub's edges
    are spread over tasks. Nothing is collected. Repeated edges and loops change nothing, edges with a null end are left out, and without edges there are no rows.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        down = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        tied = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        if e.select(F.col("v").alias("u")).distinct().join(e.select("u"), "u", "left_semi").isEmpty():  # no root hangs on another node
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row of df: id, n_shingles, component_id (the least id that its links reach, its own included), kept (id = component_id).

    Texts with equal shingle sets are one class. Classes that share one of 25 band keys of five hashes are candidates: similarity 0.8
    is missed with a chance of 5e-5. A bucket's pairs are never all listed. Its lead, the member with most candidates, is compared
    with the others: pairs are dropped by `likely`, and the rest are confirmed on whole sets, which joins families around their origin. Members
    of a bucket that are then still in other groups than its lead are compared with its other members by their differences from the
    lead (`across`), an exact join that a pair enters only if it shares rare differences. So no link between different groups is left out, and there is no cap.

    Nulls: null and empty texts have no shingles and stay by themselves; a null id stays by itself, with component_id null and kept true.
    Rows that repeat an id are scored by their own text; equal rows get equal results. An empty table gives an empty result.
    Columns of df other than the id and the text have no effect.
    """
    out = grouped(df, k, percent, id_col, text)
    component = F.when(F.col("cls").isNull(), F.col(id_col)).when(F.col(id_col).isNotNull(), F.col("least"))
    return out.select(id_col, "n_shingles", component.alias("component_id"), F.coalesce(component == F.col(id_col), F.lit(True)).alias("kept"))


def grouped(df: DataFrame, k: int, percent: int, id_col: str, text: str) -> DataFrame:
    """Of each row of df: id, t, n_shingles, cls, root (its group's key; null without shingles or if no row with an id has its class), least (its group's least id)."""
    found = written(signatures(df, k, id_col, text), "signatures")
    known = found.filter(F.col(id_col).isNotNull() & F.col("cls").isNotNull())
    sigs = known.groupBy("cls").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.min(id_col).alias("first"))
    sigs = written(sigs, "classes")  # equal classes have equal signatures, so any row's will do
    classes = class_groups(sigs, links(df, sigs, k, percent, id_col, text))
    return found.select(id_col, "t", "n_shingles", "cls").join(classes, "cls", "left")


def class_groups(sigs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """cls, root, least of every class (cls, first), from the node and root of those that have links: the class that stands for its group, and the group's least id."""
    if roots is None:
        return sigs.select("cls", F.col("cls").alias("root"), F.col("first").alias("least"))
    rooted = sigs.select("cls", "first").join(roots.select(F.substring("node", 6, 16).alias("cls"), F.substring("root", 6, 16).alias("root")), "cls", "left")
    rooted = written(rooted, "rooted")
    linked = rooted.filter("root IS NOT NULL")
    linked = linked.join(small(linked.groupBy("root").agg(F.min("first").alias("least"))), "root").select("cls", "root", "least")
    return linked.unionByName(rooted.filter("root IS NULL").select("cls", F.col("cls").alias("root"), F.col("first").alias("least")))


def members_of(keys: DataFrame) -> DataFrame:
    """key, node, n: a row for each class in each bucket of two or more classes; n is the bucket's size. keys: cls, key, once each.

    A node is its class's digest behind five bytes that are the lower, the more candidates it has, so the least node is the most central.
    """
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    inside = keys.join(shared, "key")
    many = F.sum("n").over(Window.partitionBy("cls"))  # the keys of one class
    rank = F.unhex(F.lpad(F.hex(F.lit(1 << 39) - F.least(many, F.lit((1 << 39) - 1))), 10, "0"))
    return inside.select("key", F.concat(rank, F.col("cls")).alias("node"), "n")


def across(family: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (lead, a, b) of a lead's family that may be linked, a outside of the lead's group and b in another group than a; and the differences (lead, node, w, d) to confirm them.

    family: lead, node, root, top (the lead's root), w, d, of leads with members in other groups. With s differences from the lead in common, x
    and y share (|x| + |y| - |dx| - |dy|) / 2 + s shingles, so they are linked if s is at least (wx + wy) / 2 (100 + percent), which is over
    0 for an x that isn't linked to the lead. Differences that only members of one group have can't be common to two groups, so a second version of a text with
    all its copies meets nothing. The others are put in order from the rarest on; if s is at least t, the first c - t + 1 of either side's c have one in common, and behind it enough are
    left. So only members meet that strayed from the lead in the same way, however large the family is.
    """
    q = 2 * (100 + percent)
    out = F.col("root") != F.col("top")
    least = family.groupBy("lead").agg(F.min("w").alias("wm"), F.min(F.when(out, F.col("w"))).alias("wo"))
    x = family.join(small(least), "lead").withColumn("ta", F.when(out, F.expr(f"greatest(1, cast(ceil((w + wm) / {q}) as int))"))).withColumn("tb", F.expr(f"greatest(1, cast(ceil((w + wo) / {q}) as int))"))
    keys = ["lead", "node", "root", "w", "ta", "tb"]
    items = x.filter("size(d) >= least(tb, coalesce(ta, tb))").select(*keys, F.explode(F.transform("d", lambda e: F.xxhash64("lead", e))).alias("g"))
    often = items.groupBy("g").agg(F.count(F.lit(1)).alias("f"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("g", "f")
    x = items.join(small(often), "g").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("f", "g"))).alias("d"))  # one document's differences
    x = written(x.withColumn("c", F.size("d")).filter("c >= least(tb, coalesce(ta, tb))"), "differences")
    side = lambda t, p: x.filter(f"c >= {t}").select("lead", F.posexplode(F.expr(f"slice(d, 1, c - {t} + 1)")).alias("i", "e"), *[F.col(c) for c in ("node", "root", "w", "c", "ta")]).select(
        "lead", F.col("e.g").alias("g"), *[F.col(c).alias(p + c) for c in ("i", "node", "root", "w", "c", "ta")]
    )
    met = side("ta", "a_").join(side("tb", "b_"), ["lead", "g"]).filter(f"a_root <> b_root AND (b_ta IS NULL OR a_node < b_node) AND least(a_c - a_i, b_c - b_i) * {q} >= a_w + b_w")
    pairs = met.select("lead", F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    return pairs, x


def leads_of(members: DataFrame) -> DataFrame:
    """a, b, n: each member b of a bucket with the bucket's lead a, its least node; n is the size of the largest bucket in which they meet."""
    lead = members.groupBy("key").agg(F.min("node").alias("a"))
    return members.join(lead, "key").filter("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.max("n").alias("n"))


def links(df: DataFrame, sigs: DataFrame, k: int, percent: int, id_col: str, text: str) -> DataFrame | None:
    """node, root of the classes that have links; None without any."""
    members = written(members_of(sigs.select("cls", F.explode("bands").alias("key"))), "members")
    if members.isEmpty():
        return None
    pairs = written(likely(with_signatures(leads_of(members), sigs), percent, ("n",)).filter("live OR n > 2"), "pairs")
    return settled(df, sigs, pairs, k, percent, id_col, text, lambda x: likely(with_signatures(x, sigs), percent, ("lead",)).filter("live"))


def settled(df: DataFrame, sigs: DataFrame, pairs: DataFrame, k: int, percent: int, id_col: str, text: str, sift: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, root of the classes that have links, from pairs (a: lead, b, n) of all buckets; sift leaves those pairs (lead, a, b) of members that may be linked."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cls", F.substring("node", 6, 16))
    wanted = written(nodes.join(sigs.select("cls", F.col("first").alias(id_col)), "cls"), "ids")
    texts = df.select(id_col, text).join(small(wanted.select(id_col)), id_col, "left_semi")
    sets = written(shingle_sets(texts, k, text).join(small(wanted.select("cls", "node")), "cls").select("node", "items"), "sets")
    apart = written(differences(pairs, sets, percent), "apart")
    edges = apart.filter("linked").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    roots = components(edges)

    x = apart.filter("n > 2").join(roots, "node", "left").join(roots.select(F.col("node").alias("lead"), F.col("root").alias("top")), "lead", "left")
    x = written(x.select("lead", "node", F.coalesce("root", "node").alias("root"), F.coalesce("top", "lead").alias("top"), "w", "d"), "families")
    open_ = written(x.filter("root <> top").select("lead").distinct(), "open")
    if open_.isEmpty():
        return roots
    pairs, d = across(x.join(small(open_), "lead"), percent)
    one = lambda c: d.select("lead", F.col("node").alias(c), F.col("w").alias(f"w{c}"), F.transform("d", lambda e: e["g"]).alias(f"d{c}"))
    more = sift(pairs).join(one("a"), ["lead", "a"]).join(one("b"), ["lead", "b"]).filter(F.size(F.array_intersect("da", "db")) * 2 * (100 + percent) >= F.col("wa") + F.col("wb"))
    more = written(more.select("a", "b"), "links")
    return roots if more.isEmpty() else components(edges.unionByName(more))


def keep_one(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay when one row of each group of `near_duplicates` does: the one with the least id, of several under that id the one with the
    least hash of id and text. It is decided by row, so unrelated texts under one id all stay.

    Nulls: rows with a null id stay, and so do rows without words. Rows equal in id and text are one if they have words: of those, the row with the least
    hash of all columns stays. An empty table gives an empty result. Columns as in df; those that start with _q_ are refused.
    """
    refuse(df, "_q_")
    found = written(grouped(df, k, percent, id_col, text).filter(F.col(id_col).isNotNull() & F.col("root").isNotNull()), "groups")
    best = found.groupBy("root").agg(F.min(F.struct(id_col, "t")).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stays = best.select("root", F.col("b.t").alias("bt"))
    gone = written(found.join(small(stays), "root").filter("t <> bt").select(F.col("t").alias("_q_t")).distinct(), "gone")
    x = df.withColumn("_q_t", F.xxhash64(id_col, text))
    left = x.join(small(gone), "_q_t", "left_anti")
    again = written(found.groupBy("t").count().filter("count > 1").select(F.col("t").alias("_q_t")), "again")
    if again.isEmpty():
        return left.select(*[F.col(f"`{c}`") for c in df.columns])
    several = left.join(small(again), "_q_t", "left_semi").withColumn("_q_h", row_hash(df))
    one = several.groupBy("_q_t").agg(F.min("_q_h").alias("_q_h"))
    several = several.dropDuplicates(["_q_t", "_q_h"]).join(one, ["_q_t", "_q_h"], "left_semi")
    return left.join(small(again), "_q_t", "left_anti").unionByName(several.drop("_q_h")).select(*[F.col(f"`{c}`") for c in df.columns])


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by links of 2-word shingles at 80 %."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w ELSE w[i:i + 1] END AS g FROM w, unnest(range(1, greatest(len(w), 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS root, doc_id AS node FROM w UNION SELECT r.root, e.y FROM r JOIN e ON e.x = r.node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT root, min(node) AS c FROM r GROUP BY root) m ON m.root = w.doc_id
"""
