"""Benchmark decontamination by spaced seeds, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, small, table, written

#: Word positions that count in a window of SPAN words. Of all pairs of masks of six words, this one finds most passages of 15
#: words with three words exchanged (97.5 %); longer passages have more windows.
MASKS = ((0, 1, 2, 6, 7, 9), (0, 1, 3, 7, 8, 9))
SPAN = 10


def tokens(text: str) -> Column:
    """Lower-cased words; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def seeds(x: DataFrame, keep: list[str], shorts: list[int]) -> DataFrame:
    """A row for each window and mask of x.words: keep, seed, place. shorts: lengths under SPAN that are hashed without a mask."""
    plans = [(m, SPAN, offsets) for m, offsets in enumerate(MASKS)] + [(-n, n, tuple(range(n))) for n in shorts]
    x = x.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))

    def hashes(mark: int, span: int, offsets: tuple[int, ...]) -> Column:
        last = F.size("h") - span
        one = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.lit(mark), *[F.get("h", i + o) for o in offsets]).alias("seed"), i.alias("place")))
        return F.when(last >= 0, one).otherwise(F.array().cast("array<struct<seed:bigint,place:int>>"))

    return x.select(*keep, F.inline(F.concat(*[hashes(*p) for p in plans])))


def overlaps(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = 0.5, min_words: int = 5, shift: int = 2) -> DataFrame:
    """id, _q_r (the row's key), item, n_item_words, n_matched, overlap, first_word of each text that holds a benchmark item.

    Windows of ten words are hashed under two masks that leave words out, so an exchanged word often isn't looked at; items and texts
    meet on equal hashes. At each hit the item is laid on the text at that offset and its words are compared one by one. n_matched are the
    item's words that are in place there or at another hit at most `shift` words away, as a word may have been put in or left out; hits farther apart are
    never added up. The best offset counts, first_word is the first of the best; overlap is the share of the item's words, and pairs of `least` or more stay.
    Items of fewer than ten words are hashed whole, without a mask, and those under min_words aren't looked for, as any text may hold them. The hashes of
    the benchmark are broadcast once they are counted to be few, else joined by shuffles; texts are looked at as a stream of hashes, and only those with hits are compared.

    Nulls: null or empty texts and items match nothing; a null id or item id is kept in the result. Repeated rows are
    found once per id, text and item. Empty tables give an empty result. Other columns have no effect, whatever their names.
    """
    items = benchmark.select(F.col(item_col).alias("_q_i"), F.col(item_text).alias("_q_text"), tokens(item_text).alias("words"))
    items = items.filter(F.size("words") >= max(1, min_words)).withColumn("_q_b", F.xxhash64("_q_i", "_q_text")).dropDuplicates(["_q_b"]).select("_q_b", "_q_i", "words")
    items = written(items, "items")
    shorts = [r[0] for r in items.filter(F.size("words") < SPAN).select(F.size("words")).distinct().collect()]  # nine numbers at most
    wanted = seeds(items, ["_q_b"], shorts).withColumnRenamed("place", "at")
    wanted = written(wanted.distinct(), "seeds")
    texts = df.select(F.col(id_col).alias("_q_d"), tokens(text).alias("words"), F.xxhash64(F.col(id_col), F.col(text)).alias("_q_r"))
    hits = seeds(texts, ["_q_r"], shorts).join(small(wanted), "seed").select("_q_r", "_q_b", (F.col("place") - F.col("at")).alias("offset")).distinct()
    hits = written(hits, "hits")
    texts = texts.join(small(hits.select("_q_r").distinct()), "_q_r", "left_semi")
    around = Window.partitionBy("_q_r", "_q_b").orderBy("offset").rangeBetween(-shift, shift)  # 2 shift + 1 offsets at most
    near = hits.withColumn("offsets", F.collect_list("offset").over(around)).join(small(items.withColumnRenamed("words", "item")), "_q_b")
    pairs = texts.join(near, "_q_r")
    same = F.filter(F.sequence(F.lit(0), F.size("item") - 1), lambda j: F.exists("offsets", lambda o: F.get("words", j + o) == F.get("item", j)))
    found = pairs.select("_q_d", "_q_r", "_q_b", "_q_i", F.size("item").alias("n_item_words"), F.struct(F.size(same).alias("n"), (-F.col("offset")).alias("o")).alias("m"))
    found = found.groupBy("_q_d", "_q_r", "_q_b", "_q_i", "n_item_words").agg(F.max("m").alias("m"))
    overlap = F.col("m.n") / F.col("n_item_words")
    return found.filter(overlap >= least).select(F.col("_q_d").alias(id_col), "_q_r", F.col("_q_i").alias(item_col), "n_item_words", F.col("m.n").alias("n_matched"), overlap.alias("overlap"), (-F.col("m.o")).alias("first_word"))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df that hold no benchmark item by `overlaps`, with df's columns. Rows with null ids, null or empty texts and repeated rows are judged by
    their own text, so they stay or go alike. An empty benchmark takes nothing away. A column of df named _q_r is refused."""
    if "_q_r" in df.columns:
        raise ValueError("a column named _q_r is taken")
    bad = written(overlaps(df, benchmark, id_col, text, least=least).select("_q_r").distinct(), "leaks")
    return df.withColumn("_q_r", F.xxhash64(F.col(id_col), F.col(text))).join(small(bad), "_q_r", "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_q_r")


#: From the statement: words that are in place at each offset, offsets where a window of ten agrees under a mask, and the best of those.
_SEEN = " OR ".join(f"list_has_all(js, [{', '.join(f'p + {o}' for o in offsets)}])" for offsets in MASKS)
OP7_SQL = f"""
WITH texts AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
items AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
tw AS (SELECT doc_id, w[i + 1] AS word, i AS place FROM texts, unnest(range(len(w))) AS u(i)),
iw AS (SELECT item_id, len(w) AS n, w[i + 1] AS word, i AS j FROM items, unnest(range(len(w))) AS u(i) WHERE len(w) >= 5),
laid AS (SELECT doc_id, item_id, n, place - j AS o, list(j) AS js FROM tw JOIN iw USING (word) GROUP BY ALL HAVING count(*) >= least(6, n)),
hits AS (SELECT * FROM laid WHERE CASE WHEN n < {SPAN} THEN len(js) = n ELSE len(list_filter(range(n - {SPAN - 1}), lambda p: {_SEEN})) > 0 END),
near AS (SELECT a.doc_id, a.item_id, a.n, a.o, len(list_distinct(flatten(list(b.js)))) AS m FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.o BETWEEN a.o - 2 AND a.o + 2 GROUP BY ALL),
best AS (SELECT doc_id, item_id, n, max(m) AS m FROM near GROUP BY ALL)
SELECT doc_id, item_id, n::INTEGER AS n_item_words, m::INTEGER AS n_matched, m / n::DOUBLE AS overlap, min(o)::INTEGER AS first_word
FROM best JOIN near USING (doc_id, item_id, n, m) WHERE m / n::DOUBLE >= 0.5 GROUP BY ALL
"""
