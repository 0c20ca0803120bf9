"""Queries over runs and their state, sources and stores, and the metrics that put several operators together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import catalog as A
from ..operators import evaluation as E
from ..operators import lifecycle as L
from ..operators import models as M
from ..operators import search as SE
from ..session import spread, table, workspace
from ..sources import collections as CO
from ..sources import files as FI
from ..sources import runs as R
from .corpus_queries import conversation_duplicate_score
from .registry import SQL, query
from .score_queries import _CS
from .search_queries import SQL_PAIRS, SQL_WORDS, _COS, _TOP, nearest, pairs
from .text_queries import STRIP, docs


@query(
    SQL_PAIRS + f""" SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE ((len(list_intersect(q, a)) / len(q) > 0.3)::INT + (len(list_intersect(q, p)) / len(q) > 0.3)::INT) / 2.0 END::DOUBLE, 6) AS relevance FROM
  (SELECT conv_id, turn, {SQL_WORDS.format('question')} AS q, {SQL_WORDS.format("coalesce(answer, '')")} AS a, {SQL_WORDS.format("substr(question, 1, 20)")} AS p FROM qa)"""
)
def context_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the chunks of a question that speak of it; its answer and its first characters stand for chunks."""
    q = F.col("question")
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(E.context_relevance(q, F.array("answer", F.substring(q, 1, 20))), 6).alias("relevance"))


@query(
    f"""WITH t AS ({_TOP}), r AS (SELECT t.query_id, 'd' || v.label AS doc, min(rank) AS rank FROM t JOIN embeddings v ON v.vec_id = t.id GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc) AS place FROM r),
e AS (SELECT vec_id AS query_id, 'd' || label AS doc FROM embeddings WHERE vec_id % 20 = 0 UNION SELECT vec_id, 'd0' FROM embeddings WHERE vec_id % 20 = 0)
SELECT e.query_id, round(count_if(coalesce(place <= 2, FALSE)) / count(*)::DOUBLE, 6) AS doc_recall_at_2, (count_if(coalesce(place <= 2, FALSE)) > 0)::INT::DOUBLE AS doc_hit_at_2, round(count_if(coalesce(place <= 5, FALSE)) / count(*)::DOUBLE, 6) AS doc_recall_at_5, (count_if(coalesce(place <= 5, FALSE)) > 0)::INT::DOUBLE AS doc_hit_at_5
FROM e LEFT JOIN p USING (query_id, doc) GROUP BY e.query_id"""
)
def documents_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and hits by document; labels stand for documents, and a query's own label and label 0 are expected."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    got = nearest(spark, sf_dir).join(e.toDF("id", "l"), "id").select("query_id", "rank", F.concat(F.lit("store/d"), "l").alias("path"))
    q = e.filter("vec_id % 20 = 0")
    return E.documents_found(got, q.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("d"), "label").alias("doc")).unionByName(q.select(F.col("vec_id").alias("query_id"), F.lit("d0").alias("doc"))), (2, 5))


_KINDS = "[" + ", ".join(f"'{k}'" for k in (*E.QUESTION_TYPES, "other")) + "]"
_NEEDS = "[" + ", ".join(f"'{k}'" for k, v in E.QUESTION_TYPES.items() if not v[0]) + "]"


@query(
    SQL_PAIRS + f""", x AS (SELECT conv_id, turn, {_KINDS}[(conv_id + turn) % 9 + 1] AS kind, lower(coalesce(answer, '')) AS low, turn % 2 = 0 AS none, turn % 3 = 0 AS denied, turn % 4 = 2 AS expected FROM qa),
m AS (SELECT *, denied AND expected AS m1, NOT list_contains({_NEEDS}, kind) AND none AS m2, expected AND NOT denied AND NOT (contains(low, 'i don''t know') OR contains(low, 'i cannot')) AS m3, none AND length(low) > 50 AS m4 FROM x)
SELECT conv_id, turn, kind, CASE WHEN m1 AND kind = 'policy' THEN TRUE ELSE NOT (m1 OR m2 OR m3) END AS passed,
  CASE WHEN m1 AND kind = 'policy' THEN 1.0::DOUBLE ELSE round((CASE WHEN m1 THEN 0.0 ELSE 1.0 END * CASE WHEN m2 THEN 0.5 ELSE 1.0 END * CASE WHEN m3 THEN 0.3 ELSE 1.0 END * CASE WHEN m4 THEN 0.7 ELSE 1.0 END)::DOUBLE, 6) END AS score,
  CASE WHEN m1 AND kind = 'policy' THEN '' ELSE concat_ws('|', CASE WHEN m1 THEN 'Unexpected ACL denial' END, CASE WHEN m2 THEN 'Missing citations' END, CASE WHEN m3 THEN 'Should have refused but didn''t' END, CASE WHEN m4 THEN 'Potential hallucination (no citations)' END) END AS violations FROM m"""
)
def rubric_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by the rubric of their question's type; ids stand for types, citations, denials and expected refusals."""
    t = F.col("turn")
    kind = F.element_at(F.array(*[F.lit(k) for k in (*E.QUESTION_TYPES, "other")]), ((F.col("conv_id") + t) % 9 + 1).cast("int"))
    r = E.rubric(F.col("kind"), F.col("answer"), t % 2, t % 3 == 0, t % 4 == 2)
    x = pairs(spark, sf_dir).withColumn("kind", kind).withColumn("r", r)
    return x.select("conv_id", "turn", "kind", "r.passed", "r.score", F.array_join("r.violations", "|").alias("violations"))


@query(
    """WITH f AS (SELECT l_suppkey AS data_source_id, l_linenumber AS version, 'ws/p/v' || l_linenumber || '/' || l_orderkey || '.txt' AS key, l_quantity AS size FROM lineitem WHERE l_suppkey % 2 = 0 OR l_linenumber > 2),
r AS (SELECT s_suppkey AS data_source_id, (s_suppkey % 9)::INTEGER AS current FROM supplier),
c AS (SELECT data_source_id, coalesce(max(CASE WHEN version = current THEN version END), max(CASE WHEN version = 1 THEN version END), max(version)) AS v FROM f JOIN r USING (data_source_id) GROUP BY ALL)
SELECT data_source_id, 8 AS version, 'ws/p/v8/' || split_part(key, '/', 4) AS key, size, v AS from_version FROM f JOIN c USING (data_source_id) WHERE version = v"""
)
def carried_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that go into version 8 of their sources without an upload; order lines stand for files, line numbers for versions."""
    n = F.col("l_linenumber")
    f = table(spark, sf_dir, "lineitem").filter("l_suppkey % 2 = 0 OR l_linenumber > 2").select(F.col("l_suppkey").alias("data_source_id"), n.alias("version"), F.concat(F.lit("ws/p/v"), n, F.lit("/"), "l_orderkey", F.lit(".txt")).alias("key"), F.col("l_quantity").alias("size"))
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("data_source_id"), (F.col("s_suppkey") % 9).cast("int").alias("current"), F.lit(8).alias("to"), F.lit("ws/p/v8/").alias("prefix"))
    return R.carry_forward(f, r)


@query(
    """SELECT o_orderkey AS file_id, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus WHEN o_custkey % 5 = 0 THEN 'FAILED' ELSE 'PROCESSED' END AS status, CASE WHEN o_orderstatus = 'O' AND o_custkey % 5 = 0 THEN 'run ' || o_custkey || ' failed' END AS error_message FROM orders"""
)
def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files once their runs ended; open orders stand for files in work, customers for runs, of which every fifth failed."""
    status = F.when(F.col("o_orderstatus") == "O", "PROCESSING").otherwise(F.col("o_orderstatus"))
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), "o_custkey", status.alias("status"), F.lit(None).cast("string").alias("error_message"))
    return R.finished(x, F.col("o_custkey") % 5 == 0, F.concat(F.lit("run "), "o_custkey", F.lit(" failed"))).drop("o_custkey")


@query(
    """WITH r AS (SELECT user_id AS run_id, event_type AS stage, CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 5 = 0 THEN 'running' ELSE 'succeeded' END AS status, event_id AS seq FROM events),
b AS (SELECT *, max(CASE WHEN status = 'failed' THEN seq END) OVER (PARTITION BY run_id, stage) AS bad FROM r),
s AS (SELECT run_id, stage, min(CASE WHEN status = 'succeeded' AND (bad IS NULL OR seq > bad) THEN seq END) AS done, arg_max(status, seq) AS last FROM b GROUP BY ALL)
SELECT run_id, count(*) AS total_stages, count(done) AS completed_stages, coalesce(string_agg(stage, ',' ORDER BY done) FILTER (done IS NOT NULL), '') AS completed, bool_or(last = 'failed') AS any_failed FROM s GROUP BY run_id"""
)
def stage_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run has completed; users stand for runs and types of events for stages."""
    i = F.col("event_id")
    status = F.when(i % 7 == 0, "failed").when(i % 5 == 0, "running").otherwise("succeeded")
    x = R.stage_summary(table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), status.alias("status"), i.alias("at")))
    return x.withColumn("completed", F.array_join("completed", ","))


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_custkey % 20 AS workspace_id, o_custkey AS product_id, o_orderdate AS asked FROM orders), l AS (SELECT i AS workspace_id, CASE WHEN i % 4 = 0 THEN -1 ELSE 2 + i % 5 END AS max_runs FROM range(18) AS t(i)),
n AS (SELECT workspace_id, date_trunc('month', asked) AS m, count(*) AS n FROM o WHERE id % 2 = 0 GROUP BY ALL), v AS (SELECT product_id, max(id % 7) AS v FROM o WHERE id % 2 = 0 GROUP BY ALL),
x AS (SELECT o.*, coalesce(n, 0) AS n, coalesce(max_runs, -1) AS lim, row_number() OVER (PARTITION BY o.workspace_id, date_trunc('month', asked) ORDER BY asked, id) AS turn FROM o LEFT JOIN n ON n.workspace_id = o.workspace_id AND n.m = date_trunc('month', asked) LEFT JOIN l ON l.workspace_id = o.workspace_id WHERE id % 2 = 1),
y AS (SELECT *, lim = -1 OR n + turn <= lim AS allowed, n + CASE WHEN lim = -1 THEN turn - 1 ELSE least(turn - 1, greatest(0, lim - n)) END AS used FROM x)
SELECT id AS request_id, workspace_id, y.product_id, used::BIGINT AS used, allowed, CASE WHEN allowed THEN (coalesce(v, 0) + sum(allowed::INT) OVER (PARTITION BY y.product_id ORDER BY asked, id ROWS UNBOUNDED PRECEDING))::BIGINT END AS version FROM y LEFT JOIN v ON v.product_id = y.product_id"""
)
def run_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation runs that are asked for, by quota and number; orders with even keys stand for runs so far, the others for requests."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 20).alias("workspace_id"), F.col("o_custkey").alias("product_id"), F.col("o_orderdate").alias("at"))
    runs = o.filter("request_id % 2 = 0").select("workspace_id", "product_id", (F.col("request_id") % 7).alias("version"), F.col("at").alias("started_at"))
    limits = spark.range(18).select(F.col("id").alias("workspace_id"), F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("id") % 5 + 2).alias("max_runs"))
    return R.numbered(o.filter("request_id % 2 = 1"), runs, limits)


_DATES = r"list_concat(list_concat(regexp_extract_all(t, '(?i)\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b', 1)[1:3], regexp_extract_all(t, '(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b', 1)[1:3]), regexp_extract_all(t, '(?i)\b\d{4}-\d{2}-\d{2}\b')[1:3])"
_STAMPED = "SELECT doc_id, text || ' Written by: ' || CASE WHEN doc_id % 2 = 0 THEN 'Jane Mary Doe, ' ELSE 'nobody, ' END || 'v' || (doc_id % 4) || '.' || (doc_id % 3) || '.0 of 2024-0' || (doc_id % 9 + 1) || '-11, May 3, 2021 and 1/2/20' AS t FROM documents"


@query(
    rf"""SELECT doc_id, dates[1] AS doc_date, array_to_string(dates[1:3], ',') AS dates, nullif(regexp_extract(t, '(?i)(?:By|Author|Written by|Created by):\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)', 1), '') AS author,
  array_to_string(regexp_extract_all(t, '(?i)\b(v|version|ver|v\.)\s*(\d+(?:\.\d+)+)\b', 2)[1:2], ',') AS versions FROM (SELECT *, {_DATES} AS dates FROM ({_STAMPED}))"""
)
def text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, author and versions in documents, at whose ends some are put."""
    i = F.col("doc_id")
    t = F.concat("text", F.lit(" Written by: "), F.when(i % 2 == 0, "Jane Mary Doe, ").otherwise("nobody, "), F.lit("v"), i % 4, F.lit("."), i % 3, F.lit(".0 of 2024-0"), i % 9 + 1, F.lit("-11, May 3, 2021 and 1/2/20"))
    x = docs(spark, sf_dir).select("doc_id", T.metadata(t).alias("m"))
    return x.select("doc_id", "m.doc_date", F.array_join("m.dates", ",").alias("dates"), "m.author", F.array_join("m.versions", ",").alias("versions"))


def _ask_sql(style: str) -> str:
    chars, count, terms, named, plain, place = T.STYLES[style]
    capital = r"regexp_matches(x, '^\p{Lu}')" if style in ("technical", "academic") else "FALSE"
    words = "[" + ", ".join(f"'{t}'" for t in terms) + "]::VARCHAR[]"
    fill = lambda form, v: "'" + form.replace("{}", f"' || {v} || '") + "'"
    pick = f"list_filter(w, lambda x: {capital} OR list_contains({words}, lower(x)))[1]"
    return f"""list_filter(list_transform(list_transform(list_filter(list_transform(string_split(text, '.'), lambda s: {STRIP.format('s')}), lambda s: length(s) > {chars})[1:3], lambda s: regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')),
      lambda w: CASE WHEN len(w) > {count} THEN CASE WHEN {pick} IS NOT NULL THEN {fill(named, pick)} ELSE {fill(plain, f'w[{(place or 0) + 1}]')} END END), lambda q: q IS NOT NULL AND length(q) BETWEEN 10 AND 50)"""


@query(f"SELECT doc_id, {', '.join(f'''CASE WHEN length({STRIP.format('text')}) < 50 THEN '' ELSE array_to_string({_ask_sql(k)}, '|') END AS {k}''' for k in T.STYLES)} FROM documents")
def question_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic questions of each document in four styles."""
    return docs(spark, sf_dir).select("doc_id", *[F.array_join(T.questions(F.col("text"), k), "|").alias(k) for k in T.STYLES])


@query(
    """SELECT doc_id, round(least(1.0::DOUBLE, ((coalesce(source <> '', FALSE))::INT + (sec <> '')::INT + (coalesce(lang <> '', FALSE))::INT) / 4.0::DOUBLE + CASE WHEN sec NOT IN ('', 'general', 'unknown', 'none') THEN 0.1::DOUBLE ELSE 0 END
  + CASE WHEN lower(coalesce(lang, '')) NOT IN ('', 'general', 'unknown', 'none') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN lower(coalesce(lang, '')) NOT IN ('', 'unknown', 'general') THEN 0.1::DOUBLE ELSE 0 END + 0.1::DOUBLE), 6) AS presence
FROM (SELECT *, lower(['', 'General', 'intro'][doc_id % 3 + 1]) AS sec FROM documents)"""
)
def metadata_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a record says about itself; the language stands for field and audience, ids for sections."""
    sec = F.element_at(F.array(F.lit(""), F.lit("General"), F.lit("intro")), (F.col("doc_id") % 3 + 1).cast("int"))
    p = S.metadata_presence(F.col("source"), sec, F.col("lang"), F.lit(None).cast("string"), F.col("lang"), F.col("doc_id"))
    return docs(spark, sf_dir).select("doc_id", F.round(p, 6).alias("presence"))


@query(
    f"""WITH p AS (SELECT vec_id AS point_id, vec_id // 4 AS chunk, embedding, label, 'text ' || (vec_id % 14) AS text FROM embeddings WHERE vec_id % 2 = 0),
t AS (SELECT q.vec_id AS query_id, v.point_id, v.chunk, v.label, v.text, {_COS} AS score FROM embeddings q, p v WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 12) DESC, v.point_id) <= 50),
o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, chunk ORDER BY round(score, 12) DESC, point_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, point_id) AS p FROM o WHERE chunk IN (SELECT chunk FROM p WHERE label IN (1, 2, 3)) QUALIFY p <= 4),
d AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY p) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p)::INTEGER AS place, 'c' || chunk AS chunk_id, point_id, round(score, 6) AS score, text, 1::INTEGER AS tokens FROM d"""
)
def playground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in one workspace, product, version and collection by a user with rules on three documents; labels stand for documents."""
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    points = e.select(
        i.alias("point_id"), F.concat(F.lit("c"), F.floor(i / 4)).alias("chunk_id"), "embedding", F.concat(F.lit("text "), i % 14).alias("text"), F.concat(F.lit("d"), "label").alias("document_id"), F.lit("body").alias("field_name"),
        (i % 2).alias("workspace_id"), F.lit("p").alias("product_id"), F.lit(1).alias("version"), F.lit("col").alias("collection_id"),
    )
    acls = spark.createDataFrame([("u", "document", None, "d1, d2,d3", None)], "user_id string, access_type string, index_scope string, doc_scope string, field_scope string")
    q = e.filter("vec_id % 20 = 0").select(i.alias("query_id"), F.lit("text").alias("query"), "embedding")
    out = SE.ask(q, points, {"workspace_id": 0, "product_id": "p", "version": 1, "collection_id": "col"}, acls, "u", top_k=4)
    return out.select("query_id", "place", "chunk_id", "point_id", F.round("score", 6).alias("score"), "text", "tokens")


_DUP = SQL["conversation_duplicate_score"]


@query(
    f"""WITH c AS (SELECT conv_id, coalesce(text, '') AS text, {STRIP.format("coalesce(text, '')")} AS st FROM conversations), s AS (SELECT *, list_transform({_CS}, lambda x: list_distinct(regexp_extract_all(lower(x), '[^\\x20\\x09-\\x0D]+'))) AS a FROM c),
m AS (SELECT round(1 - avg((NOT regexp_matches(st, '[.!?][''")\\]]*$') AND (NOT regexp_matches(st, '[0-9A-Za-z_]$') OR length(st) < 20))::INT) + 1e-9, 4) AS boundary,
  round(avg(round((CASE WHEN length(st) < 50 THEN 0.0 WHEN len(a) < 2 THEN 1.0 ELSE list_avg(list_transform(range(2, len(a) + 1), lambda i: len(list_intersect(a[i - 1], a[i]))::DOUBLE / len(list_distinct(list_concat(a[i - 1], a[i]))))) END)::DOUBLE + 1e-9, 4)) + 1e-9, 4) AS coherence, count(*) AS chunks FROM s),
e AS (SELECT conv_id, count(*) AS n, count(DISTINCT text) AS u FROM c GROUP BY conv_id), d AS ({_DUP}),
q AS (SELECT CASE WHEN n < 2 THEN 1.0 ELSE greatest(0.0, least(1.0, 0.7::DOUBLE * u / n + 0.3::DOUBLE * score / 100)) END AS u FROM e JOIN d USING (conv_id))
SELECT any_value(chunks) AS chunks, count(*) AS documents, any_value(boundary) AS chunk_boundary_quality, any_value(coherence) AS chunk_coherence, round(avg(u) + 1e-9, 4) AS uniqueness, round(1 - round(avg(u) + 1e-9, 4), 4) AS duplicate_ratio FROM q, m"""
)
def conversation_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures that only a set of documents cut to chunks has; conversations stand for documents and turns for chunks. Uniqueness is 0.7 of the exact and 0.3 of the near kind,
    by document and then in the mean; boundary quality is what the rate of cut sentences leaves."""
    c = table(spark, sf_dir, "conversations").withColumn("text", T.text_of("text"))
    t = F.col("text")
    m = c.agg(F.count(F.lit(1)).alias("chunks"), S.rounded(1 - F.avg(T.ends_mid_sentence(t).cast("int"))).alias("chunk_boundary_quality"), S.rounded(F.avg(S.rounded(S.connectivity(t)))).alias("chunk_coherence"))
    exact = c.groupBy("conv_id", F.md5(t).alias("h")).agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u"))
    both = exact.join(conversation_duplicate_score(spark, sf_dir).select("conv_id", "score").hint("merge"), "conv_id")  # a row for each document, not for the driver
    u = F.when(F.col("n") < 2, 1.0).otherwise(T.clip(F.col("u") * 0.7 / F.col("n") + F.col("score") * 0.3 / 100))
    g = both.agg(F.count(F.lit(1)).alias("documents"), S.rounded(F.avg(u)).alias("uniqueness"))
    return m.join(g, F.lit(True)).withColumn("duplicate_ratio", F.round(1 - F.col("uniqueness"), 4))


@query()
def embedded_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of documents by a model hook; a small model of letter counts stands for one, so there is no SQL and a test recounts it."""
    return docs(spark, sf_dir).select("doc_id", F.round(M.coherence(F.col("text"), letters), 6).alias("coherence"))


def letters(texts: list[str]):  # noqa: ANN201
    """A vector of letter counts, in place of a model."""
    import numpy as np

    return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float)


@query("SELECT doc_id, md5(coalesce(text, '')) AS text_md5, lang, source FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines, in folders by language, and read again."""
    path = workspace(spark, "jsonl")
    FI.write_jsonl(docs(spark, sf_dir).select("doc_id", "text", "source", "lang"), path, ("lang",))
    return FI.read_jsonl(spark, path, "doc_id bigint, text string, source string, lang string").select("doc_id", F.md5("text").alias("text_md5"), "lang", "source")


@query("SELECT item_id, md5(text || chr(10)) AS text_md5, 'utf-8' AS extracted_by, octet_length(encode(text)) + 1 AS length FROM benchmark WHERE item_id % 5 <> 0")
def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as files of a folder, listed with patterns, synchronised twice into a catalogue, and turned into text."""
    path = workspace(spark, "folder")
    table(spark, sf_dir, "benchmark").select(F.concat(F.when(F.col("item_id") % 5 == 0, "skip-").otherwise("item-"), "item_id").alias("part"), F.col("text").alias("value")).repartition(1).write.partitionBy("part").text(path)
    con = FI.Connector(path, include=("*.txt",), exclude=("_*",))
    for _ in range(2):  # the second one changes nothing
        con.sync(spark, f"{path}-catalogue")
    x = FI.texts(FI.synced(spark, f"{path}-catalogue")).withColumn("part", F.regexp_extract("path", r"part=([a-z]+-\d+)/", 1)).filter("part NOT LIKE 'skip-%'")
    return x.select(F.regexp_extract("part", r"(\d+)", 1).cast("bigint").alias("item_id"), F.md5("text").alias("text_md5"), "extracted_by", "length")


@query(
    """SELECT query, expected, reason FROM (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN '  ' ELSE 'q"' || item_id || ', ' || substr(text, 1, 20) END AS query, 'c' || item_id || '|c2' AS expected, CASE WHEN item_id % 7 = 0 THEN 'blank query' WHEN item_id % 5 = 0 THEN 'bad metadata' END AS reason FROM benchmark)
WHERE reason IS NULL UNION ALL SELECT CASE WHEN item_id % 7 = 0 THEN '  ' ELSE 'q"' || item_id || ', ' || substr(text, 1, 20) END, NULL, CASE WHEN item_id % 7 = 0 THEN 'blank query' ELSE 'bad metadata' END FROM benchmark WHERE item_id % 7 = 0 OR item_id % 5 = 0"""
)
def imported_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items written to CSV and imported: those that pass, and the others with the reason."""
    i = F.col("item_id")
    q = F.when(i % 7 == 0, "  ").otherwise(F.concat(F.lit('q"'), i, F.lit(", "), F.substring("text", 1, 20)))
    path = workspace(spark, "csv")
    x = table(spark, sf_dir, "benchmark").select(q.alias("query"), F.concat(F.lit("c"), i, F.lit(" , c2")).alias("expected_chunks"), F.when(i % 5 == 0, "{bad").otherwise('{"k": 1}').alias("metadata"))
    x.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    good, bad = FI.import_items(spark, path)
    return good.select("query", F.array_join("expected_chunks", "|").alias("expected"), F.lit(None).cast("string").alias("reason")).unionByName(bad.select("query", F.lit(None).cast("string").alias("expected"), "reason"))


@query("SELECT lpad(vec_id::VARCHAR, 9, '0') AS point_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id > 10 ORDER BY vec_id LIMIT 25")
def collection_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points put into a collection, a third of them again with another label, found by the alias and read as a page; the limit is the page's."""
    store = CO.Collections(spark, workspace(spark, "collections"), buckets=8)
    name = CO.collection("Work Space", "Some product", 1)
    x = table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("point_id"), "label", "embedding", F.col("vec_id").alias("n"))
    store.upsert(name, x)
    store.upsert(name, x.filter("n % 3 = 0").withColumn("label", F.col("label") + 100))
    store.set_alias(CO.alias("Work Space", "Some product"), name)
    return store.scroll(store.resolve(CO.alias("Work Space", "Some product")), after="000000010", limit=25).select("point_id", "label")


@query("SELECT count(*) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, '7' AS version FROM benchmark")
def exported_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of chunks and vectors that were exported."""
    path = workspace(spark, "bundle")
    FI.export_bundle(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings"), path, "7")
    return spark.read.schema("chunks bigint, vectors bigint, version string").json(f"{path}/manifest")


@query(
    """SELECT url, filename, md5(html) AS html_md5 FROM (SELECT url, html, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/', '_') || '.html' AS filename FROM pages ORDER BY page_id LIMIT 50)"""
)
def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the web source names their files; fifty is the source's own limit."""
    return FI.web_pages(table(spark, sf_dir, "pages")).select("url", "filename", F.md5("html").alias("html_md5"))


_GATES = ", ".join(f"('{g}', {v}::DOUBLE)" for g, v in E.GATES.items())


@query(
    f"""WITH m AS (SELECT user_id AS run_id, user_id % 3 AS product_id, CASE event_type WHEN 'click' THEN 'groundedness' WHEN 'view' THEN 'hallucination_rate' ELSE 'answer_relevance' END AS metric, round(avg(value) / 100, 6) AS value FROM events GROUP BY ALL),
o AS (SELECT * FROM (VALUES (1, 'groundedness_min', 0.4::DOUBLE), (2, 'hallucination_rate_max', 0.9), (2, 'answer_relevance_min', NULL)) AS v(product_id, gate, threshold)),
g AS (SELECT r.run_id, q.gate, coalesce(o.threshold, d) AS threshold, regexp_replace(q.gate, '_(min|max)$', '') AS metric FROM (SELECT DISTINCT run_id, product_id FROM m) r CROSS JOIN (VALUES {_GATES}) AS q(gate, d) LEFT JOIN o ON o.product_id = r.product_id AND o.gate = q.gate),
p AS (SELECT g.run_id, gate, threshold, value AS actual, coalesce(CASE WHEN ends_with(gate, '_min') THEN value >= threshold ELSE value <= threshold END, FALSE) AS passed FROM g LEFT JOIN m ON m.run_id = g.run_id AND m.metric = g.metric)
SELECT *, bool_and(passed) OVER (PARTITION BY run_id) AS all_passed FROM p"""
)
def run_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of each run by default and by its product's own thresholds; users stand for runs and types of events for metrics."""
    metric = F.when(F.col("event_type") == "click", "groundedness").when(F.col("event_type") == "view", "hallucination_rate").otherwise("answer_relevance")
    m = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id"), (F.col("user_id") % 3).alias("product_id"), metric.alias("metric")).agg(F.round(F.avg("value") / 100, 6).alias("value"))
    o = spark.createDataFrame([(1, "groundedness_min", 0.4), (2, "hallucination_rate_max", 0.9), (2, "answer_relevance_min", None)], "product_id bigint, gate string, threshold double")
    return E.run_gates(m, o)


@query(
    """WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS artifact_id, l_orderkey AS run_id, l_shipmode_ AS stage, 'a' || l_linenumber AS name, 'k/' || l_orderkey || '/' || l_linenumber AS key, CASE WHEN l_linenumber % 2 = 0 THEN 'delete_after_90_days' ELSE 'keep_forever' END AS policy, l_linenumber AS n
  FROM (SELECT *, 's' || l_linenumber AS l_shipmode_, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1),
i AS (SELECT DISTINCT a.artifact_id, b.artifact_id AS input_id, b.stage, b.name, b.key FROM a JOIN a b ON b.artifact_id = a.artifact_id - 1 OR b.artifact_id = a.artifact_id - 2)
SELECT a.artifact_id, a.run_id, a.stage, a.name, a.key, CASE WHEN policy = 'delete_after_90_days' AND run_id % 4 = 0 THEN 'delete_after_90_days_if_failed' ELSE policy END AS policy, 'ACTIVE' AS status, coalesce(s, '') AS inputs
FROM a LEFT JOIN (SELECT artifact_id, string_agg(input_id || ':' || name, ',' ORDER BY input_id) AS s FROM i GROUP BY artifact_id) USING (artifact_id)"""
)
def registered_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts as they are put on record, with their inputs; order lines stand for artifacts, each made from the two before, orders for runs, of which every fourth failed."""
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("artifact_id"), F.col("l_orderkey").alias("run_id"), n).repartition("artifact_id").distinct()  # numbers alone are shuffled, once
    x = lines.select("artifact_id", "run_id", F.concat(F.lit("s"), n).alias("stage"), F.concat(F.lit("a"), n).alias("name"), F.concat(F.lit("k/"), "run_id", F.lit("/"), n).alias("key"), F.when(n % 2 == 0, "delete_after_90_days").otherwise("keep_forever").alias("policy"))
    inputs = lines.select("artifact_id", F.explode(F.array(F.col("artifact_id") - 1, F.col("artifact_id") - 2)).alias("input_id"))
    failed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id")).filter("run_id % 4 = 0")
    out = A.registered(x, inputs, failed, ("artifact_id", "name"))
    return out.withColumn("inputs", F.array_join(F.transform("inputs", lambda i: F.concat(i["artifact_id"], F.lit(":"), i["name"])), ","))


@query(
    """WITH e AS (SELECT event_type, ts::DATE AS d, (SELECT max(ts)::DATE FROM events) AS last FROM events)
SELECT event_type, count_if(datediff('day', d, last) > 7)::BIGINT AS archived, count_if(datediff('day', d, last) <= 7)::BIGINT AS kept FROM e GROUP BY event_type"""
)
def archived_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that were moved to the archive as they were over a week older than the last one, and those that stay."""
    e = table(spark, sf_dir, "events")
    path = workspace(spark, "archive")
    last = F.lit(e.agg(F.max("ts")).first()[0])
    left = A.archive(e, "ts", last, 7, path, ["event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))
    old = spark.read.schema(e.schema).parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("archived"))
    return old.join(left, "event_type", "full_outer").select("event_type", F.coalesce("archived", F.lit(0)).cast("bigint").alias("archived"), F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"))


@query()
def section_chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paged files: a page for each turn, a heading for each role; their chunk records with all provenance that isn't a text."""
    turns = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    page = F.concat(F.lit("=== PAGE "), (F.col("turn") + 1).cast("string"), F.lit(" ===\n"), F.upper("role"), F.lit(" MESSAGE\n"), F.col("text"))
    files = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", page.alias("page")))), lambda p: p["page"]), "\n").alias("text"))  # one conversation's turns
    x = L.chunk_records(files, "conv_id", max_tokens=60, overlap=40, least=20, product="chat", at="2024-01-01T00:00:00Z")
    return x.select("chunk_id", "doc_id", "page", "section", "section_index", "section_confidence", "chunk_index", "chunk_of", "raw_start", "raw_end", "whole", "token_est", "cleaned_text_hash", "source_checksum", "audience", "index_scope", "doc_scope", "field_scope")


@query()
def section_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the chunk records of documents: chunks, tokens, share of the raw text that they cover, and mean confidence, by language and section."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    x = L.chunk_records(spread(docs.select("doc_id", "text"), "doc_id", "text"), "doc_id", max_tokens=200, overlap=100)
    x = x.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "section")
    return x.agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_est").cast("bigint").alias("tokens"), F.sum(F.col("whole").cast("bigint")).alias("whole"), F.sum(F.col("raw_end") - F.col("raw_start")).alias("raw_chars"), F.round(F.avg("section_confidence"), 6).alias("confidence"))
