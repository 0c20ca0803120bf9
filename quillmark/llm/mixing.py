"""Mixing sources to target weights by a splitting tree, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from .common import WORD, key60, refuse, rejoin, row_hash, running, stratum, table, written

WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its size, and no document more than so many copies.
CAP = 3
SEED = "mix-1"


def words(text: str = "text") -> Column:
    """Number of words of a nullable text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (_q_s, source_size) with target: what each gives of the sum of all sizes.

    Weights repeat in the order of _q_s. A target stops at cap times its source's size, and what is over goes to the others by weight,
    until none is above. That is a water level: with the sources in order of cap size per weight, the level behind the first i
    is (all - their caps) / (the others' weights), and the first source that the level leaves under its cap ends the search. One row per source.
    """
    one = Window.orderBy("_q_s")
    x = sources.withColumn("_w", _weight(F.row_number().over(one), weights))
    x = x.withColumn("_cap", F.col("source_size") * cap)
    level = Window.orderBy((F.col("_cap") / F.col("_w")), "_q_s")
    up = level.rowsBetween(Window.unboundedPreceding, -1)
    down = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    x = x.withColumn("_l", (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(up), F.lit(0))) / F.sum("_w").over(down)).withColumn("_o", F.row_number().over(level))
    free = F.when(F.col("_l") * F.col("_w") <= F.col("_cap"), F.struct("_o", "_l"))
    x = x.withColumn("_level", F.min(free).over(whole)["_l"])
    return x.select("_q_s", "source_size", F.coalesce(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")), F.col("_cap").cast("double")).alias("target"))


def _weight(place: Column, weights: tuple[int, ...]) -> Column:
    """The weight at a place that counts from 1."""
    return F.element_at(F.array(*[F.lit(w) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))


def hypergeometric(total: Column, marked: Column, draws: Column, u: Column) -> Column:
    """How many of `marked` among `total` are in a draw of `draws` without replacement, by the inverse of the distribution's sums at u of [0, 1).

    Sums go from the mode upwards and then from the mode downwards; each term comes from its neighbour, so no factorial is needed. Terms farther
    than 40 and 12 standard deviations from the mode have a chance under 1e-30 in all and are left out.
    """
    zero, one = F.lit(0.0), F.lit(1.0)

    def more(s: Column, *fields: str, **new: Column) -> Column:
        return F.struct(*[s[f].alias(f) for f in fields], *[c.cast("double").alias(n) for n, c in new.items()])

    def walk(s: Column, steps: Column, target: Column | None, above: bool) -> Column:
        """Sum of the terms, or how many sums are at most target."""

        def step(acc: Column, i: Column) -> Column:
            x = s["mode"] + i if above else s["mode"] - i
            free = s["n"] - s["k"] - s["d"] + x
            if above:
                after, term, counts = acc["w"] * ((s["k"] - x) * (s["d"] - x) / ((x + 1) * (free + 1))), acc["w"], F.lit(True)
            else:
                after, term, counts = acc["w"] * (x * free / ((s["k"] - x + 1) * (s["d"] - x + 1))), F.when(i > 0, acc["w"]).otherwise(zero), i > 0
            now = acc["t"] + term
            seen = zero if target is None else acc["c"] + F.when(counts & (now <= target), one).otherwise(zero)
            return F.struct(after.alias("w"), now.alias("t"), seen.alias("c"))

        start = F.struct(one.alias("w"), zero.alias("t"), zero.alias("c"))
        return F.aggregate(F.sequence(F.lit(0), steps.cast("int")), start, step, lambda acc: acc["t" if target is None else "c"])

    # Each step binds what the next ones use several times, so that nothing is written out or computed more than once.
    raw = F.struct(total.cast("double").alias("n"), marked.cast("double").alias("k"), draws.cast("double").alias("d"), u.alias("u"))
    f = ("n", "k", "d", "u")
    ends = lambda s: more(s, *f, low=F.greatest(zero, s["d"] + s["k"] - s["n"]), high=F.least(s["k"], s["d"]))
    mode = lambda s: more(s, *f, "low", "high", mode=F.least(s["high"], F.greatest(s["low"], F.floor((s["d"] + 1) * (s["k"] + 1) / (s["n"] + 2)).cast("double"))), reach=F.floor(F.lit(40) + 12 * F.sqrt(s["d"] * s["k"] / F.greatest(s["n"], one) + 1)))
    steps = lambda s: more(s, *f, "mode", up=F.least(s["high"] - s["mode"], s["reach"]), down=F.least(s["mode"] - s["low"], s["reach"]))
    sums = lambda s: more(s, *f, "mode", "up", "down", above=walk(s, s["up"], None, True), below=walk(s, s["down"], None, False))
    goal = lambda s: more(s, *f, "mode", "up", "down", "above", goal=s["u"] * (s["above"] + s["below"]))
    over = lambda s: more(s, *f, "mode", "up", "down", "above", "goal", over=walk(s, s["up"], s["goal"], True))
    found = lambda s: F.when(s["over"] <= s["up"], s["mode"] + s["over"]).otherwise(s["mode"] - F.least(walk(s, s["down"], s["goal"] - s["above"], False) + 1, s["down"])).cast("long")
    return let(let(let(let(let(let(let(raw, ends), mode), steps), sums), goal), over), found)


def drawn(members: Column, total: Column, draws: Column, seed: Column) -> Column:
    """Members (k, q) with x, their parts of a draw of `draws` from all `total`: a multivariate hypergeometric draw, one member after the other."""
    kind = "array<struct<k:string,q:bigint,x:bigint>>"

    def step(acc: Column, e: Column) -> Column:
        left, d = acc["left"] - acc["q"], acc["d"] - acc["x"]
        x = hypergeometric(left, e["q"], d, key60(seed, e["k"]) / F.lit(float(1 << 60)))
        before = F.when(acc["k"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["k"].alias("k"), acc["q"].alias("q"), acc["x"].alias("x")))))
        return F.struct(left.alias("left"), d.alias("d"), e["k"].alias("k"), e["q"].alias("q"), x.alias("x"), before.alias("out"))

    zero = F.lit(0).cast("long")
    start = F.struct(total.alias("left"), draws.alias("d"), F.lit(None).cast("string").alias("k"), zero.alias("q"), zero.alias("x"), F.array().cast(kind).alias("out"))
    return F.aggregate(members, start, step, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["k"].alias("k"), acc["q"].alias("q"), acc["x"].alias("x")))))


def split_tree(blocks: DataFrame, n_shards: int, seed: str = SEED, group: int = 1024) -> DataFrame:
    """_q_s, mix_shard, q: how many of each source's q blocks (_q_s, q) each output shard gets.

    A node of the tree stands for a range of shards and holds exact block quotas by source. Its blocks are cut in proportion to the
    shards on either side, and what each source gives to the left is a multivariate hypergeometric draw from the node's quotas; the rest goes right. Only the quotas are looked at, no
    block. Sources are drawn in groups of about `group`: first the groups' parts, then the sources' parts of their group's, so a node's arrays hold about
    the square root of very many sources. Draws come from an MD5 of seed, node and source, so reruns agree. Without blocks the result is empty.
    """
    sources = blocks.count()
    groups = -(-sources // group)
    x = blocks.select(F.lit(0).alias("a"), F.lit(n_shards).alias("b"), F.pmod(F.xxhash64("_q_s"), F.lit(max(1, groups))).cast("string").alias("g"), F.col("_q_s").alias("k"), F.col("q").cast("long").alias("q"))
    member = lambda c, q: F.sort_array(F.collect_list(F.struct(F.col(c).alias("k"), F.col(q).alias("q"))))
    many, left = F.col("b") - F.col("a"), F.expr("(b - a) div 2").cast("int")
    node = F.concat_ws("|", F.lit(seed), F.lit("tree"), F.col("a").cast("string"), F.col("b").cast("string"))
    draw = drawn(F.col("m"), F.col("gq"), F.col("d"), node)  # the same at each level
    for _ in range(max(0, n_shards - 1).bit_length()):
        part = x.groupBy("a", "b", "g").agg(member("k", "q").alias("m"), F.sum("q").alias("gq"))  # a group's sources at one node
        if groups > 1:  # read twice
            part = written(part, "nodes")
            top = part.groupBy("a", "b").agg(member("g", "gq").alias("gm"), F.sum("gq").alias("n"))
            top = top.select("a", "b", F.explode(drawn(F.col("gm"), F.col("n"), F.expr("n * ((b - a) div 2) div (b - a)"), F.concat_ws("|", node, F.lit("group")))).alias("e"))
            part = part.join(top.select("a", "b", F.col("e.k").alias("g"), F.col("e.x").alias("d")), ["a", "b", "g"])
        else:
            part = part.withColumn("d", F.expr("gq * ((b - a) div 2) div (b - a)"))
        got = part.select("a", "b", "g", F.explode(draw).alias("e")).withColumn("left", left).withColumn("many", many)
        side = F.when(F.col("many") < 2, F.array(F.struct("a", "b", F.col("e.q").alias("q")))).otherwise(
            F.array(F.struct("a", (F.col("a") + F.col("left")).alias("b"), F.col("e.x").alias("q")), F.struct((F.col("a") + F.col("left")).alias("a"), "b", (F.col("e.q") - F.col("e.x")).alias("q")))
        )
        x = got.select("g", F.col("e.k").alias("k"), F.inline(side)).filter("q > 0").select("a", "b", "g", "k", "q")
    return written(x.select(F.col("k").alias("_q_s"), F.col("a").alias("mix_shard"), "q"), "tree")


def placements(df: DataFrame, by: str = "source", id_col: str = "doc_id", size: str = "size", n_shards: int = 8, block_words: int = 8192, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, unused: bool = False) -> DataFrame:
    """As `mix`, but of narrow rows with their size in a column: all columns of df, and _q_s and _rank, a row's source and place in it."""
    amount = F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0))
    added = ("size", "source_size", "target", "copy", "mix_shard", "mix_order")
    names = [c for c in df.columns if c not in added]
    plain = [F.col(f"`{c}`") for c in names]
    x = df.select(*plain, stratum(by).alias("_q_s"), amount.alias("_q_z"), key60(seed, F.col(f"`{id_col}`")).alias("_q_k"))
    n = df.count()
    sources = targets(x.groupBy("_q_s").agg(F.sum("_q_z").alias("source_size")), weights, cap)
    placed = running(x, ["_q_s"], "_q_k", [F.col(f"`{id_col}`"), row_hash(df.select(*plain))], n, {"_q_z": "_q_before"})
    placed = placed.join(written(sources, "targets"), "_q_s")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - full * F.col("source_size")
    copies = F.when(F.col("_q_z") > 0, full + (F.col("_q_before") + F.col("_q_z") / 2 <= rest).cast("int")).otherwise(0).cast("int")
    each = placed.withColumn("_q_n", copies)
    each = each.withColumn("copy", F.explode_outer(F.when(F.col("_q_n") > 0, F.sequence(F.lit(0), F.col("_q_n") - 1))))
    block = F.expr(f"(copy * source_size + _q_before) div {block_words}")
    each = written(each.withColumn("_q_block", block), "entries")
    shards = deal(each.filter("copy IS NOT NULL").select("_q_s", "_q_block"), n_shards, seed)
    each = each.join(shards, ["_q_s", "_q_block"], "left")
    order = F.when(F.col("copy").isNotNull(), key60(seed, F.lit("order"), F.col("mix_shard"), F.col("copy"), F.col(f"`{id_col}`")))
    out = each if unused else each.filter("copy IS NOT NULL")
    return out.select(*plain, F.col("_q_z").alias("size"), "source_size", "target", "copy", "mix_shard", order.alias("mix_order"), "_q_s", "_rank")


def mix(df: DataFrame, by: str = "source", id_col: str = "doc_id", text: str = "text", n_shards: int = 8, block_words: int = 8192, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row for each copy of a row of df that the mix takes, with size, source_size, target, copy (from 0), mix_shard and mix_order.

    A row's size is its number of words. Sources, in order of their names (null last), share the sum of all
    sizes by `weights`, up to `cap` times their size. A source's rows are in a seeded order; it gives floor(target / size) copies of
    all of them, and of those at the start of the order as many more as come nearest to the target: it is met to half a document.
    What a source gives, copy after copy, is cut into blocks of about block_words; `split_tree` draws how many blocks of each source an output shard
    gets, and each source's blocks, in a random order, are dealt to the shards by these numbers, so no block is dealt twice. Inside a shard rows are to be put in the order of mix_order.
    Orders are exact ranks made by buckets (`running`), so a source with a third of all rows is spread over tasks. All of this is done
    on narrow rows; texts are joined to them once at the end.

    Nulls: a null source is a source of its own; a null text has no words. Rows without words are never taken. Repeated rows are rows
    like any other. An empty table gives an empty result. Reruns agree. Columns of df named like the added ones are replaced; those that start with _q_ are refused.
    """
    refuse(df, "_q_")
    added = ("size", "source_size", "target", "copy", "mix_shard", "mix_order")
    x = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added])
    narrow = written(x.select(*[F.col(f"`{c}`") for c in dict.fromkeys((id_col, by))], row_hash(x).alias("_q_t"), words(text).alias("size")), "sizes")
    taken = written(placements(narrow, by, id_col, "size", n_shards, block_words, weights, cap, seed).select(F.col(f"`{id_col}`").alias("_q_i"), "_q_t", *added), "taken")
    return rejoin(x, id_col, narrow, taken)


def deal(entries: DataFrame, n_shards: int, seed: str) -> DataFrame:
    """mix_shard of each block (_q_s, _q_block) of entries."""
    name = [F.col("_q_s"), F.col("_q_block")]
    tokens = written(entries.distinct().withColumn("_q_p", key60(seed, F.lit("deal"), *name)), "tokens")
    quotas = split_tree(tokens.groupBy("_q_s").agg(F.count(F.lit(1)).alias("q")), n_shards, seed)
    ends = quotas.withColumn("end", F.sum("q").over(Window.partitionBy("_q_s").orderBy("mix_shard")))
    ends = ends.groupBy("_q_s").agg(F.sort_array(F.collect_list(F.struct("end", "mix_shard"))).alias("ends"))  # n_shards entries a source at most
    order = running(tokens, ["_q_s"], "_q_p", name, tokens.count()).join(ends, "_q_s")
    return written(order.select("_q_s", "_q_block", F.expr("filter(ends, e -> e.end > _rank)[0].mix_shard").alias("mix_shard")), "deal")


def write_mix(df: DataFrame, path: str, n_shards: int = 8) -> None:
    """Writes a mix as path/mix_shard=<k>/, shuffled inside each shard by mix_order. Repeated rows and null columns are written as they are; an empty mix writes no shard."""
    df.repartitionByRange(n_shards, "mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order").write.partitionBy("mix_shard").mode("overwrite").parquet(path)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and the shards that its copies are in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words().alias("size"))
    taken = placements(written(docs, "sizes"), unused=True)
    rows = taken.groupBy("_q_s", "_rank").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", "source")], F.sum(F.when(F.col("copy").isNotNull(), F.col("size")).otherwise(0)).alias("taken"), F.sort_array(F.collect_list(F.struct("copy", "mix_shard"))).alias("c")
    )  # a document has three copies at most
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", F.array_join(F.expr("transform(filter(c, e -> e.copy IS NOT NULL), e -> cast(e.mix_shard as string))"), ",").alias("mix_shards"))


def _level(i: int) -> str:
    """SQL of one level of the tree: quotas q<i> by node and source give q<i + 1>. Terms come from gamma functions here."""
    term = "lgamma({x} + 1) + lgamma(q - {x} + 1) + lgamma(d - {x} + 1) + lgamma(n - q - d + {x} + 1)"
    return f"""
o{i} AS (SELECT a, b, s, q, row_number() OVER (PARTITION BY a, b ORDER BY encode(s)) AS i FROM q{i}),
c{i} AS (
  SELECT a, b, 0::BIGINT AS i, ''::VARCHAR AS s, 0::BIGINT AS q, sum(q)::BIGINT AS n, (sum(q)::BIGINT * ((b - a) // 2) // (b - a))::BIGINT AS d, 0::BIGINT AS x FROM o{i} GROUP BY a, b
  UNION ALL
  SELECT a, b, i, s, q, n, d, xs[1 + len(list_filter(range(1, len(ws) + 1), lambda k: list_sum(ws[1:k]) <= u * list_sum(ws)))]::BIGINT FROM (
    SELECT *, list_transform(xs, lambda x: exp({term.format(x="m")} - ({term.format(x="x")}))) AS ws FROM (
      SELECT *, list_concat(range(m, least(q, d) + 1), list_reverse(range(greatest(0, d + q - n), m))) AS xs FROM (
        SELECT *, least(least(q, d), greatest(greatest(0, d + q - n), floor((d + 1)::DOUBLE * (q + 1) / (n + 2))::BIGINT)) AS m FROM (
          SELECT c.a, c.b, o.i, o.s, o.q, c.n - c.q AS n, c.d - c.x AS d, ('0x' || substr(md5('mix-1|tree|' || c.a || '|' || c.b || '|' || o.s), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u
          FROM c{i} c JOIN o{i} o ON c.a = o.a AND c.b = o.b AND o.i = c.i + 1))))),
q{i + 1} AS (
  SELECT a, a + (b - a) // 2 AS b, s, x AS q FROM c{i} WHERE i > 0 AND x > 0 AND b - a > 1 UNION ALL
  SELECT a + (b - a) // 2, b, s, q - x FROM c{i} WHERE i > 0 AND q > x AND b - a > 1),"""


OP5_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS z,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
src AS (SELECT s, sum(z)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY encode(s)) - 1) % 3 + 1)::INT] AS w FROM sized GROUP BY s),
lev AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER o AS pos,
         ((sum(source_size) OVER ())::BIGINT - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w::DOUBLE, encode(s) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
           / (sum(w) OVER (ORDER BY 3 * source_size / w::DOUBLE, encode(s) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS l
  FROM src WINDOW o AS (ORDER BY 3 * source_size / w::DOUBLE, encode(s))),
lam AS (SELECT arg_min(l, pos) AS level FROM lev WHERE l * w <= cap),
tgt AS (SELECT s, source_size, coalesce(least(cap::DOUBLE, level * w), cap::DOUBLE) AS target FROM lev, lam),
pre AS (
  SELECT sized.*, source_size, target, coalesce(sum(z) OVER (PARTITION BY s ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS f
  FROM sized JOIN tgt USING (s)),
cop AS (SELECT *, CASE WHEN z > 0 THEN (f + CASE WHEN b + z / 2.0 <= target - f * source_size THEN 1 ELSE 0 END)::BIGINT ELSE 0 END AS n FROM pre),
ent AS (SELECT s, doc_id, c.c AS c, (c.c * source_size + b) // 8192 AS block FROM cop, unnest(range(n)) AS c(c)),
tok AS (SELECT DISTINCT s, block, ('0x' || substr(md5('mix-1|deal|' || s || '|' || block), 1, 15))::BIGINT AS p FROM ent),
q0 AS (SELECT 0::BIGINT AS a, 8::BIGINT AS b, s, count(*)::BIGINT AS q FROM tok GROUP BY s),""" + "".join(map(_level, range(3))) + """
ends AS (SELECT s, a AS leaf, sum(q) OVER (PARTITION BY s ORDER BY a) AS stop, sum(q) OVER (PARTITION BY s ORDER BY a) - q AS start FROM q3),
shards AS (SELECT t.s, block, leaf FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, block) - 1 AS r FROM tok) t JOIN ends e ON e.s = t.s AND t.r >= start AND t.r < stop)
SELECT doc_id, z AS size, source_size, target, z * n AS taken, source, coalesce(m, '') AS mix_shards
FROM cop LEFT JOIN (SELECT ent.s, doc_id, string_agg(leaf::VARCHAR, ',' ORDER BY c) AS m FROM ent JOIN shards ON ent.s = shards.s AND ent.block = shards.block GROUP BY ALL) USING (s, doc_id)
"""
