"""Queries that put operators together: detection by product, stage rollups, the whole search, reports, template answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as K
from ..functions import text as T
from ..operators import evaluation as E
from ..operators import search as S
from ..session import table
from .config import PLAYBOOKS
from .label_queries import SQL_ROUTE
from .registry import query
from .search_queries import SQL_PAIRS, SQL_WORDS, _COS, nearest, pairs
from .text_queries import NW, STRIP, docs


@query(
    f"""WITH r AS (SELECT source, playbook, count(*) AS n FROM (SELECT d.source, p.playbook FROM documents d JOIN ({SQL_ROUTE}) p USING (doc_id)) GROUP BY ALL)
SELECT source, playbook, n AS votes FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, playbook) = 1"""
)
def detected_playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The playbook that most documents of a source are routed to."""
    x = docs(spark, sf_dir).select("source", K.route(F.col("text"), F.col("source")).alias("playbook")).groupBy("source", "playbook").agg(F.count(F.lit(1)).alias("votes"))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("votes"), "playbook"))).filter("r = 1").drop("r")


_TECH = PLAYBOOKS["TECH"]


@query(
    rf"""WITH t AS (SELECT source, {STRIP.format('text')} AS t, text, {NW} AS w FROM documents),
f AS (SELECT source, w, NOT regexp_matches(t, '[.!?][''")\]]*$') AND (NOT regexp_matches(t, '[0-9A-Za-z_]$') OR length(t) < 20) AS cut, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS lines FROM t)
SELECT coalesce(source, 'all') AS source, count(*) AS files, sum(w)::BIGINT AS words, sum(lines)::BIGINT AS lines, round(avg(cut::INT), 4) AS mid_sentence_rate, avg(lines) >= {_TECH.min_sections} AS enough_sections, round(avg(cut::INT), 4) <= {_TECH.max_mid_sentence} AS boundaries_ok FROM f GROUP BY ROLLUP (source)"""
)
def preprocess_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, words, lines and the rate of cut sentences by source and in all, against the gates of a playbook."""
    t = F.col("text")
    x = docs(spark, sf_dir).select("source", T.n_words(t).alias("w"), T.ends_mid_sentence(t).cast("int").alias("cut"), F.size(F.filter(F.split(t, "\n"), lambda v: v != "")).alias("lines"))
    g = x.rollup("source").agg(F.count(F.lit(1)).alias("files"), F.sum("w").alias("words"), F.sum("lines").alias("lines"), F.round(F.avg("cut"), 4).alias("mid_sentence_rate"), (F.avg("lines") >= _TECH.min_sections).alias("enough_sections"))
    return g.withColumn("source", F.coalesce("source", F.lit("all"))).withColumn("boundaries_ok", F.col("mid_sentence_rate") <= _TECH.max_mid_sentence)


@query(
    f"""WITH t AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label, {_COS} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) <= 50),
d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS place, id, label, round(score, 6) AS score FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5"""
)
def search_with_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty nearest, one per chunk (here label), the best five: the depth of the dense search and of its answer."""
    x = nearest(spark, sf_dir, 50).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    one = x.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "id"))).filter("r = 1")
    best = one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter("place <= 5")
    return best.select("query_id", "place", "id", "label", F.round("score", 6).alias("score"))


@query(
    SQL_PAIRS
    + f""", v AS (SELECT conv_id, turn, least(1.0, len(list_intersect({SQL_WORDS.format('question')}, {SQL_WORDS.format('answer')})) / greatest(len({SQL_WORDS.format('question')}), 1) * 0.7 + least(1.0, length(answer) / 100) * 0.3)::DOUBLE AS r FROM qa WHERE question <> '' AND answer <> '')
SELECT 'query' AS part, conv_id || ':' || turn AS name, printf('%.4f', round(round(r, 6), 4)) AS value FROM v UNION ALL SELECT 'aggregate', 'answer_relevance', printf('%.4f', round(round(avg(r), 6), 4)) FROM v UNION ALL SELECT 'gate', 'answer_relevance_min', CASE WHEN avg(r) >= 0.8 THEN 'passed' ELSE 'failed' END FROM v"""
)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long report: a row for each query, for the aggregate and for the gate, with four decimals."""
    x = pairs(spark, sf_dir).filter("question <> '' AND answer <> ''").select("conv_id", "turn", E.answer_relevance(F.col("question"), F.col("answer")).alias("r"))
    four = lambda c: F.format_string("%.4f", F.round(F.round(c, 6), 4))
    rows = x.select(F.lit("query").alias("part"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("name"), four(F.col("r")).alias("value"))
    a = x.agg(F.avg("r").alias("r"))
    return rows.unionByName(a.select(F.lit("aggregate").alias("part"), F.lit("answer_relevance").alias("name"), four(F.col("r")).alias("value"))).unionByName(
        a.select(F.lit("gate").alias("part"), F.lit("answer_relevance_min").alias("name"), F.when(F.col("r") >= E.GATES["answer_relevance_min"], "passed").otherwise("failed").alias("value"))
    )


@query(
    SQL_PAIRS
    + f""", s AS (SELECT conv_id, turn, question, unnest(list_filter(list_transform(regexp_split_to_array(answer, '[.!?]+'), lambda x: {STRIP.format('x')}), lambda x: x <> '')) AS sentence,
  generate_subscripts(list_filter(list_transform(regexp_split_to_array(answer, '[.!?]+'), lambda x: {STRIP.format('x')}), lambda x: x <> ''), 1) AS n FROM qa),
o AS (SELECT *, len(list_intersect({SQL_WORDS.format('question')}, {SQL_WORDS.format('sentence')})) / greatest(len({SQL_WORDS.format('question')}), 1) AS overlap FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC, n) AS r FROM o WHERE overlap > 0.05)
SELECT conv_id, turn, string_agg(sentence, '. ' ORDER BY r) AS answer FROM r WHERE r <= 5 GROUP BY conv_id, turn"""
)
def template_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers put together from the five sentences that share most words with the question."""
    x = pairs(spark, sf_dir).select("conv_id", "turn", E.wordset(F.col("question")).alias("q"), F.posexplode(T.sentences(F.col("answer"))).alias("n", "sentence"))
    overlap = F.size(F.array_intersect("q", E.wordset(F.col("sentence")))) / F.greatest(F.size("q"), F.lit(1))
    w = Window.partitionBy("conv_id", "turn").orderBy(F.desc("o"), "n")
    best = x.withColumn("o", overlap).filter("o > 0.05").withColumn("r", F.row_number().over(w)).filter("r <= 5")
    return best.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "sentence"))), lambda s: s["sentence"]), ". ").alias("answer"))


@query("SELECT o_orderkey, round(100 * pow(0.5, (epoch(TIMESTAMP '1998-08-02') - epoch(o_orderdate)) / 86400 / 365), 1) AS freshness FROM orders")
def freshness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness that halves each year, at a fixed date."""
    return table(spark, sf_dir, "orders").select("o_orderkey", S.freshness(F.col("o_orderdate").cast("timestamp"), F.lit("1998-08-02").cast("timestamp")).alias("freshness"))


@query(
    f"""SELECT doc_id, mode, round(CASE WHEN mode = 'pattern' OR (mode = 'hybrid' AND n > 500) THEN 0.0 ELSE n / 4.0 / 1000 * (0.00015 + 0.0006) END, 10)::DOUBLE AS cost FROM (SELECT doc_id, length(text) AS n, CASE doc_id % 3 WHEN 0 THEN 'pattern' WHEN 1 THEN 'hybrid' ELSE 'llm' END AS mode FROM documents)"""
)
def enhancement_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What enhancing a text by a language model would cost: a quarter of its characters as tokens, in and out; hybrid mode skips good texts, here long ones."""
    n = F.length("text")
    mode = F.when(F.col("doc_id") % 3 == 0, "pattern").when(F.col("doc_id") % 3 == 1, "hybrid").otherwise("llm")
    x = docs(spark, sf_dir).withColumn("mode", mode)
    return x.select("doc_id", "mode", F.round(T.enhancement_cost(n, F.col("mode"), n > 500), 10).alias("cost"))
