"""Lexical search: an inverted index in segments, BM25 with exact sums and bounds that leave postings out, phrases, and fusion of rankings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import arrow_map, workspace
from ..sources.merge import MergeTable

#: A term is a run of letters and digits of any script, in lower case.
TERM = r"[\p{L}\p{N}]+"
#: The usual constants of BM25, and the unit of a score: gains are whole numbers, so sums don't depend on their order.
K1, B, UNIT = 1.2, 0.75, 1_000_000
#: Postings, at most, that the first bound of a query is taken from, if its rarest term has no more.
LEAD = 1000
#: Terms of a change for each task and file of a bucket, about.
PART = 4_000_000
#: Largest side, in narrow rows, that is broadcast after it was counted.
FEW = 200_000
#: Postings for each task that sums them, about.
SUMMED = 1_000_000


def terms(text: Column) -> Column:
    """The terms of a text, in its order; a null text has none."""
    return F.regexp_extract_all(F.lower(T.text_of(text)), F.lit(TERM), F.lit(0))


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, h, len, term, tf, positions of each term of each text, from its terms in order: doc, h, len, w."""
    for b in batches:
        flat, lens = b.column(3).flatten(), b.column(3).value_lengths().to_numpy()
        if not len(flat):
            continue
        coded = flat.dictionary_encode()
        row, pos = np.repeat(np.arange(b.num_rows), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        key = row * len(coded.dictionary) + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        ends = np.append(first, len(flat)).astype(np.int32)
        one = order[first]
        positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[order].astype(np.int32)))
        made = [*(c.take(pa.array(row[one])) for c in b.columns[:3]), flat.take(pa.array(one)), pa.array(np.diff(ends)), positions]
        yield pa.RecordBatch.from_arrays(made, [*b.schema.names[:3], "term", "tf", "positions"])


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _first(df: DataFrame, k: int) -> DataFrame:
    """rank, from 1, of the k rows of each query with the highest scores; equal scores by doc."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= k)


class Lexical:
    """An index under one path that is kept up by its changes.

    path/postings/segment=<change>/bucket=<b>/ holds a row for each term and text of one change: doc, h (the text's hash), len, tf, positions; b is a hash of the term, so a search reads the buckets of its
    terms only. path/log has the texts of each change, and path/docs, merged when read, says which text of a document counts. It is committed last, so a change that didn't end is never seen; a text that
    was replaced or removed leaves dead postings, which are kept out by an anti-join against the (few) texts that are in the log and don't count. A change of few terms writes one
    file a bucket, and a term in a third of all texts of a large one is spread over up to `spread` tasks and files.

    Rows without an id are left out, as nothing can be found by them. Texts without terms count in the number and mean length of texts. Of several texts of an id in one change that of the greatest hash counts.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, spread: int = 256) -> None:
        self.spark, self.path, self.buckets, self.spread = spark, path.rstrip("/"), buckets, spread
        self.docs = MergeTable(spark, f"{self.path}/docs", "doc", buckets)

    # Changes.

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> None:
        """Puts texts in, or in the place of those with the same id. One shuffle of terms, already by bucket."""
        made = f"s{uuid.uuid4().hex}"
        x = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text}`").alias("t"))
        x = x.select("doc", F.xxhash64(T.text_of("t")).alias("h"), terms(F.col("t")).alias("w")).withColumn("len", F.size("w"))
        x.select("doc", "h", "len", F.lit(made).alias("segment")).write.parquet(f"{self.path}/log/{made}")
        log = self.spark.read.parquet(f"{self.path}/log/{made}")
        parts = min(self.spread, 1 + (log.agg(F.sum("len")).first()[0] or 0) // (PART * self.buckets))
        # Equal rows of an id are one; only they are shuffled for that.
        again = log.groupBy("doc", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc", "h")
        if not again.isEmpty():
            again = _few(again)
            x = x.join(again, ["doc", "h"], "left_anti").unionByName(x.join(again, ["doc", "h"], "left_semi").dropDuplicates(["doc", "h"]))
        each = arrow_map(x.select("doc", "h", "len", "w"), _by_term, f"doc {dict(x.dtypes)['doc']}, h long, len int, term string, tf int, positions array<int>")
        each = each.withColumn("bucket", self._bucket()).repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(parts))).select("bucket", "term", "doc", "h", "len", "tf", "positions")
        each.sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={made}")
        self.docs.upsert(log, order="h")

    def remove(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Takes texts out by id; unknown ids do nothing."""
        self.docs.delete(ids.select(F.col(f"`{id_col}`").alias("doc")))

    # Reading.

    def _postings(self, asked: DataFrame, *more: str) -> DataFrame:
        """The living postings of the terms asked for: term, doc, len, tf. They are written once, as each reader would else look for the dead ones anew."""
        live = self.docs.read()
        kind = live.schema["doc"].dataType.simpleString()
        whole = StructType.fromDDL(f"term string, doc {kind}, h long, len int, tf int, positions array<int>, segment string, bucket int")
        every = self.spark.read.schema(whole).parquet(f"{self.path}/postings")
        dead = self.spark.read.schema(live.schema).parquet(f"{self.path}/log/*").join(live, ["doc", "h", "segment"], "left_anti").select("doc", "h", "segment").distinct()
        wanted = asked.select("term").distinct().withColumn("bucket", self._bucket())
        x = every.select("bucket", "term", "doc", "h", "segment", "len", "tf", *more).join(_few(wanted), ["bucket", "term"], "left_semi")
        x = x.join(_few(dead), ["doc", "h", "segment"], "left_anti").select("term", "doc", "len", "tf", *more)
        path = workspace(self.spark, "postings")
        x.write.parquet(path)
        return self.spark.read.schema(x.schema).parquet(path)

    def search(self, queries: DataFrame, k: int = 10, id_col: str = "query_id", text: str = "query") -> DataFrame:
        """query_id, rank, doc, score (long, in UNIT): the k texts of the highest BM25 score of each query, each of its terms once; a query without known terms has none.

        The k-th best sum over a query's rarest terms is a bound that the k-th best score can't be under. Its terms are put in order of the most that they can give, and a text that only holds
        those at the low end, which can't reach the bound together, isn't ranked. Postings are shuffled once, by text, so that all sums of a text are made in one task and only each task's
        best are put together. No text is lost: equal scores stay in.
        """
        n, mean = self.docs.read().agg(F.count(F.lit(1)), F.avg("len")).first()
        mean = float(mean or 0) or 1.0
        q = queries.select(F.col(f"`{id_col}`").alias("query_id"), F.explode(F.array_distinct(terms(F.col(f"`{text}`")))).alias("term")).distinct()
        post = self._postings(q).withColumn("g", F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean)))
        stats = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("g").alias("most"))
        stats = stats.withColumn("idf", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        gain = F.floor(F.col("idf") * F.col("g") * UNIT).cast("long")
        # Windows over the terms of one query.
        rare = Window.partitionBy("query_id").orderBy("df", "term")
        low = Window.partitionBy("query_id").orderBy("bound", "term")
        qt = q.join(stats, "term").withColumn("bound", F.floor(F.col("idf") * F.col("most") * UNIT).cast("long") + 1)
        qt = qt.withColumn("lead", (F.sum("df").over(rare) <= LEAD) | (F.row_number().over(rare) == 1)).withColumn("below", F.sum("bound").over(low)).select("query_id", "term", "idf", "lead", "below")
        first = post.join(_few(qt.filter("lead")), "term").groupBy("query_id", "doc").agg(F.sum(gain).alias("score"))
        reach = _first(first, k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("c")).filter(F.col("c") == k).select("query_id", "floor")
        qt = qt.join(reach, "query_id", "left").withColumn("needed", F.col("below") >= F.coalesce("floor", F.lit(0))).select("query_id", "term", "idf", "needed")
        by_text = post.repartition(1 + post.count() // SUMMED, "doc").join(_few(qt), "term")
        whole = by_text.groupBy("query_id", "doc").agg(F.sum(gain).alias("score"), F.bool_or("needed").alias("needed")).filter("needed").select("query_id", "doc", "score")
        return _first(whole, k).select("query_id", "rank", "doc", "score")

    def phrases(self, queries: DataFrame, id_col: str = "query_id", text: str = "query") -> DataFrame:
        """query_id, doc, hits (long): the texts that hold all terms of a query side by side, in its order, and at how many places. A query without terms is nowhere.

        Its rarest term says where it may start; the others are only looked up in those texts.
        """
        q = queries.select(F.col(f"`{id_col}`").alias("query_id"), terms(F.col(f"`{text}`")).alias("w"))
        q = q.select("query_id", "w", F.size("w").alias("n"), F.posexplode("w").alias("at", "term")).distinct()
        post = self._postings(q, "positions")
        often = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        rare = Window.partitionBy("query_id", "w").orderBy(F.coalesce("df", F.lit(0)), "at")  # the terms of one query
        q = q.join(often, "term", "left").withColumn("lead", F.row_number().over(rare) == 1)
        start = lambda p: F.transform(p, lambda x: x - F.col("at"))
        found = post.join(_few(q.filter("lead").select("query_id", "w", "n", "at", "term")), "term").select("query_id", "w", "n", "doc", F.col("at").alias("lead"), start(F.col("positions")).alias("starts"))
        rest = found.select("query_id", "w", "n", "doc", "lead", "starts", F.posexplode("w").alias("at", "term")).filter("at <> lead").drop("lead")
        rest = post.select("term", "doc", "positions").join(_few(rest), ["term", "doc"]).select("query_id", "w", "n", "doc", F.array_intersect("starts", start(F.col("positions"))).alias("starts"))
        x = found.drop("lead").unionByName(rest).select("query_id", "w", "n", "doc", F.explode("starts").alias("start"))
        whole = x.groupBy("query_id", "w", "n", "doc", "start").agg(F.count(F.lit(1)).alias("c")).filter("c = n")
        return whole.groupBy("query_id", "doc").agg(F.count_distinct("w", "start").alias("hits"))


def fuse(rankings: list[DataFrame], k: int = 10, damp: int = 60) -> DataFrame:
    """query_id, rank, doc, score: the k rows of each query with the highest sum of 1 / (damp + rank) over rankings (query_id, rank, doc); a row that a ranking lacks gets nothing from it."""
    x = rankings[0].select("query_id", "rank", "doc")
    for r in rankings[1:]:
        x = x.unionByName(r.select("query_id", "rank", "doc"))
    # Whole parts of 10**12, so that equal ranks give equal sums in any order.
    part = F.floor(F.lit(10.0**12) / (F.col("rank") + damp)).cast("long")
    x = x.groupBy("query_id", "doc").agg(F.sum(part).alias("score"))
    return _first(x, k).select("query_id", "rank", "doc", (F.col("score") / 10.0**12).alias("score"))
