"""Queries over an inverted index of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexical import Lexical
from ..session import table, workspace
from .registry import query

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def indexed(spark: SparkSession, sf_dir: str) -> Lexical:
    """An index of all documents, put in as two changes: those of odd ids first, then all of them, so that half of the first postings are dead."""
    docs = table(spark, sf_dir, "documents")
    index = Lexical(spark, workspace(spark, "lexical"), buckets=16)
    index.add(docs.filter("doc_id % 2 = 1").withColumn("text", F.reverse("text")))
    index.add(docs)
    return index


@query(
    f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(w) AS term, len(w) AS len FROM d) GROUP BY doc_id, term),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
g AS (SELECT item_id, doc_id, sum(floor(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.75::DOUBLE * len / mean + 0.25::DOUBLE))) * 1000000)::BIGINT)::BIGINT AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM g QUALIFY rank <= 10"""
)
def lexical_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of the highest BM25 score for each benchmark item, after half of the documents were replaced."""
    hits = indexed(spark, sf_dir).search(table(spark, sf_dir, "benchmark"), 10, "item_id", "text")
    return hits.select(F.col("query_id").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


@query(
    f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), q AS (SELECT item_id, {_WORDS} AS q FROM benchmark),
c AS (SELECT * FROM d JOIN q ON len(q) > 0 AND contains(' ' || list_aggregate(w, 'string_agg', ' ') || ' ', ' ' || list_aggregate(q, 'string_agg', ' ') || ' '))
SELECT item_id, doc_id, len(list_filter(range(1, len(w) - len(q) + 2), lambda i: w[i : i + len(q) - 1] = q))::BIGINT AS hits FROM c"""
)
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item as a phrase, whatever signs are between its words, and how often."""
    hits = indexed(spark, sf_dir).phrases(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return hits.select(F.col("query_id").alias("item_id"), F.col("doc").alias("doc_id"), "hits")
