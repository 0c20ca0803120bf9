"""Queries over vectors, retrieval, access and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import ivf as IV
from ..operators import search as S
from ..operators import vectors as V
from ..session import table, workspace
from .registry import query
from .text_queries import L, NW, R, STRIP, docs

_COS = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_TOP = f"SELECT q.vec_id AS query_id, v.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id QUALIFY rank <= 10"


def nearest(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Every vector whose id is divisible by 20, against all others."""
    e = table(spark, sf_dir, "embeddings")
    return V.top_k(e.filter("vec_id % 20 = 0"), e, k)


@query(f"SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score FROM ({_TOP})")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors by cosine."""
    return nearest(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(
    f"""WITH t AS ({_TOP}), h AS (SELECT t.query_id, count_if(v.label = q.label) AS same, avg((v.label = q.label)::INT) AS p FROM t JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = id GROUP BY t.query_id)
SELECT count(*) AS queries, round(avg((same > 0)::INT), 6) AS recall_at_k, round(avg(p), 6) AS precision_at_k FROM h"""
)
def label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out retrieval: how often a vector of the same label is among the ten nearest, and their share."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    x = nearest(spark, sf_dir).join(e.toDF("id", "l"), "id").join(e.toDF("query_id", "ql"), "query_id").withColumn("same", (F.col("l") == F.col("ql")).cast("int"))
    g = x.groupBy("query_id").agg(F.max("same").alias("hit"), F.avg("same").alias("p"))
    return g.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("hit"), 6).alias("recall_at_k"), F.round(F.avg("p"), 6).alias("precision_at_k"))


@query(
    """WITH n AS (SELECT len(embedding) AS dim, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm, list_bool_or(list_transform(embedding, lambda v: isnan(v) OR isinf(v))) AS bad FROM embeddings),
s AS (SELECT median(norm) AS median, stddev_pop(norm) AS sd, avg(norm) AS mean FROM n WHERE NOT bad), u AS (SELECT mode(dim) AS usual FROM n)
SELECT usual::INTEGER AS dim, count(*) AS vectors, count_if(dim = usual)::BIGINT AS same_dim, count_if(bad)::BIGINT AS bad, count_if(NOT bad AND norm > 0)::BIGINT AS non_zero, count_if(NOT bad AND abs(norm - median) > 3 * sd)::BIGINT AS outliers,
  round(median, 6) AS median_norm, round(mean, 6) AS mean_norm, round(sd, 6) AS sd_norm, round((count_if(dim = usual) * 0.4 + count_if(NOT bad) * 0.3 + count_if(NOT bad AND norm > 0) * 0.3) / count(*)::DOUBLE, 6) AS quality
FROM n, s, u GROUP BY usual, median, mean, sd"""
)
def vector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions, norms, outliers and quality of all vectors."""
    return V.quality(table(spark, sf_dir, "embeddings"))


@query(
    """SELECT doc_id, list_transform(range(0, 40), lambda i: round(CASE WHEN i = 0 THEN least(length(text) / 1000, 1.0) ELSE (('0x' || substr(h, (i % 32) * 2 + 1, 2))::INT - 128) / 128 END, 6)) AS vector FROM (SELECT doc_id, text, sha256(text) AS h FROM documents)"""
)
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's hash embedding in all of its places, so that the digest is repeated."""
    return docs(spark, sf_dir).select("doc_id", F.transform(V.hash_embedding(F.col("text"), 40), lambda v: F.round(v, 6)).alias("vector"))


@query("SELECT vec_id AS point_id, label, len(embedding)::INTEGER AS dim FROM embeddings WHERE label IN (1, 3, 5) AND vec_id > 100 ORDER BY vec_id LIMIT 50")
def filtered_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of fifty points behind an id, with a payload filter."""
    x = S.payload_filter(table(spark, sf_dir, "embeddings"), {"label": [1, 3, 5]}).filter("vec_id > 100")
    return x.orderBy("vec_id").limit(50).select(F.col("vec_id").alias("point_id"), "label", F.size("embedding").alias("dim"))


@query(
    f"""WITH t AS ({_TOP}), r AS (SELECT query_id, count(*) AS n FROM (SELECT q.vec_id AS query_id FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) GROUP BY query_id),
h AS (SELECT t.query_id, min(CASE WHEN v.label = q.label THEN rank END) AS first, sum(CASE WHEN v.label = q.label THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count_if(v.label = q.label) AS ink, count_if(v.label = q.label AND rank <= 5) AS inp
  FROM t JOIN embeddings q ON q.vec_id = t.query_id JOIN embeddings v ON v.vec_id = t.id GROUP BY t.query_id)
SELECT coalesce(h.query_id, r.query_id) AS query_id, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) AS x(i)), 0), 6) AS ndcg,
  CASE WHEN ink > 0 AND n IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, round(coalesce(ink / n::DOUBLE, 0), 6) AS recall, round(coalesce(inp / 5.0::DOUBLE, 0), 6) AS precision FROM h FULL JOIN r ON h.query_id = r.query_id"""
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRR, NDCG, hit rate, recall and precision of the nearest vectors; those of the query's label are expected."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    n = e.filter("label IS NOT NULL").groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n")).filter("n > 0")
    need = e.filter("vec_id % 20 = 0").join(n, "label").select(F.col("vec_id").alias("query_id"), "n")
    hit = nearest(spark, sf_dir).join(e.toDF("id", "l"), "id").join(e.toDF("query_id", "ql"), "query_id")
    return E.retrieval_of(hit.select("query_id", "rank", F.coalesce(F.col("l") == F.col("ql"), F.lit(False)).alias("rel")), need)


SQL_PAIRS = "WITH u AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS r2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), qa AS (SELECT conv_id, turn, text AS question, answer FROM u WHERE role = 'user' AND r2 = 'assistant')"
SQL_WORDS = r"list_distinct(regexp_extract_all(lower({}), '[^\x20\x09-\x0D]+'))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of users and the answers that follow them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, sf_dir, "conversations").withColumn("text", T.text_of("text")).withColumn("answer", F.lead("text").over(w)).withColumn("r2", F.lead("role").over(w))
    return x.filter("role = 'user' AND r2 = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


_REF = " OR ".join("contains(lower(answer), '{}')".format(p.replace("'", "''")) for p in E.REFUSALS)


@query(
    SQL_PAIRS + f""", s AS (SELECT *, {SQL_WORDS.format('question')} AS q, {SQL_WORDS.format('answer')} AS a FROM qa)
SELECT conv_id, turn, round(CASE WHEN question = '' OR answer = '' THEN 0.0 ELSE least(1.0, len(list_intersect(q, a)) / greatest(len(q), 1) * 0.7 + least(1.0, length(answer) / 100) * 0.3) END::DOUBLE, 6) AS relevance,
  round(CASE WHEN question <> '' THEN len(list_intersect(q, a)) / greatest(len(list_distinct(list_concat(q, a))), 1) END::DOUBLE, 6) AS correctness,
  CASE WHEN (turn % 4 = 2) = (turn % 3 = 0 OR answer = '' OR {_REF}) THEN 1.0 WHEN turn % 4 = 2 THEN 0.0 ELSE 0.3 END::DOUBLE AS refusal FROM s"""
)
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance, correctness against the question's words, and correctness of refusals; turns stand for denials and expected refusals."""
    q, a = F.col("question"), F.col("answer")
    refusal = E.refusal_correctness(a, F.col("turn") % 3 == 0, F.col("turn") % 4 == 2, F.lit(True))
    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(E.answer_relevance(q, a), 6).alias("relevance"), F.round(E.answer_correctness(q, a), 6).alias("correctness"), refusal.alias("refusal"))


_CLAIMS = f"list_filter(list_transform(regexp_split_to_array(answer, '[.!?]+'), lambda x: {STRIP.format('x')}), lambda x: length(x) > 20)[1:10]"


@query(
    SQL_PAIRS + f""", c AS (SELECT conv_id, turn, unnest({_CLAIMS}) AS claim FROM qa), k AS (SELECT conv_id, turn AS t2, {SQL_WORDS.format('text')} AS w FROM conversations WHERE role = 'user'),
g AS (SELECT c.conv_id, c.turn, c.claim, bool_or(len(list_intersect({SQL_WORDS.format('claim')}, k.w)) / greatest(len({SQL_WORDS.format('claim')}), 1) > 0.3) AS ok FROM c JOIN k USING (conv_id) GROUP BY c.conv_id, c.turn, c.claim)
SELECT conv_id, turn, count(*) AS claims, count_if(ok)::BIGINT AS supported, round(count_if(ok) / count(*)::DOUBLE, 6) AS groundedness FROM g GROUP BY conv_id, turn"""
)
def groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an answer's distinct claims that some user turn of its conversation supports; user turns stand for retrieved chunks."""
    c = pairs(spark, sf_dir).select("conv_id", "turn", F.explode(E.claims(F.col("answer"))).alias("claim")).distinct()
    k = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", E.wordset(T.text_of("text")).alias("w"))
    ws = E.wordset(F.col("claim"))
    ok = F.size(F.array_intersect(ws, F.col("w"))) / F.greatest(F.size(ws), F.lit(1)) > 0.3
    g = c.join(k, "conv_id").groupBy("conv_id", "turn", "claim").agg(F.bool_or(ok).alias("ok"))
    return g.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("claims"), F.count_if("ok").alias("supported"), F.round(F.count_if("ok") / F.count(F.lit(1)), 6).alias("groundedness"))


@query(
    SQL_PAIRS + r""", m AS (SELECT *, regexp_replace(answer, '(\w+)\. ', '\1 [' || (turn % 3 + 1) || ']. ', 'g') AS marked FROM qa), p AS (SELECT *, list_distinct(regexp_extract_all(marked, '\[\d+\]')) AS marks,
  list_filter(list_transform(regexp_split_to_array(marked, '[.!?]+\s+'), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: length(x) > 15)[1:15] AS parts FROM m),
c AS (SELECT *, CASE WHEN len(parts) = 0 THEN 1.0 ELSE len(list_filter(parts, lambda s: len(list_filter(marks, lambda k: instr(marked, k) > 0 AND instr(marked, k) >= instr(marked, s) - 100 AND instr(marked, k) <= instr(marked, s) + length(s) + 100)) > 0)) / greatest(len(parts), 1) END AS cover FROM p)
SELECT conv_id, turn, round(CASE WHEN len(marks) = 0 THEN 0.5 ELSE cover * 0.7 + 0.5 * 0.3 END::DOUBLE, 6) AS coverage FROM c"""
)
def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of an answer's claims by marks, which are put behind sentences; one of two cited ids is valid."""
    marked = F.expr(r"regexp_replace(answer, '(\\w+)\\. ', concat('$1 [', turn % 3 + 1, ']. '))")
    x = pairs(spark, sf_dir).withColumn("m", marked)
    return x.select("conv_id", "turn", F.round(E.citation_coverage(F.col("m"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"))), 6).alias("coverage"))


_AGG = (
    SQL_PAIRS + f""", s AS (SELECT *, {SQL_WORDS.format('question')} AS q, {SQL_WORDS.format('answer')} AS a FROM qa), v AS (SELECT least(1.0, len(list_intersect(q, a)) / greatest(len(q), 1) * 0.7 + least(1.0, length(answer) / 100) * 0.3)::DOUBLE AS answer_relevance,
  CASE WHEN answer = '' OR {_REF} THEN 0.3 ELSE 1.0 END::DOUBLE AS refusal_correctness FROM s),
y AS (SELECT 'answer_relevance' AS metric, answer_relevance AS value FROM v UNION ALL SELECT 'refusal_correctness', refusal_correctness FROM v), """
)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a = F.col("question"), F.col("answer")
    return pairs(spark, sf_dir).select(E.answer_relevance(q, a).alias("answer_relevance"), E.refusal_correctness(a, F.lit(False), F.lit(False), F.lit(True)).alias("refusal_correctness"))


@query(_AGG + "g AS (SELECT 1) SELECT metric, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*) AS n FROM y GROUP BY metric")
def evaluation_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, least and greatest of each metric over all answers."""
    a = E.aggregates(_scores(spark, sf_dir), ["answer_relevance", "refusal_correctness"])
    return a.withColumn("min", F.round("min", 6)).withColumn("max", F.round("max", 6))


@query(
    _AGG + """g AS (SELECT metric, round(avg(value), 6) AS mean FROM y GROUP BY metric), t AS (SELECT * FROM (VALUES ('groundedness_min', 0.8), ('citation_coverage_min', 0.9), ('refusal_correctness_min', 0.95), ('context_relevance_min', 0.75), ('answer_relevance_min', 0.8)) AS t(gate, threshold))
SELECT gate, threshold::DOUBLE AS threshold, mean AS actual, coalesce(mean >= threshold, FALSE) AS passed FROM t LEFT JOIN g ON g.metric || '_min' = gate
UNION ALL SELECT 'hallucination_rate_max', 0.05, 1 - sum(mean) FILTER (metric = 'refusal_correctness'), coalesce(1 - sum(mean) FILTER (metric = 'refusal_correctness') <= 0.05, FALSE) FROM g"""
)
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on the aggregates; metrics that weren't measured fail."""
    a = E.aggregates(_scores(spark, sf_dir), ["answer_relevance", "refusal_correctness"])
    return E.gates(a, {"hallucination_rate_max": 1 - F.sum(F.when(F.col("metric") == "refusal_correctness", F.col("mean")))})


@query(
    """SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, arg_min(value, (ts, value)) AS first, arg_max(value, (ts, value)) AS last, round(avg((value >= 50)::INT), 6) AS pass_rate,
  CASE WHEN arg_max(value, (ts, value)) > arg_min(value, (ts, value)) THEN 'improving' WHEN arg_max(value, (ts, value)) < arg_min(value, (ts, value)) THEN 'declining' ELSE 'stable' END AS direction FROM events WHERE value IS NOT NULL GROUP BY event_type"""
)
def metric_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a metric moved over time, by kind of run."""
    return E.trend(table(spark, sf_dir, "events").filter("value IS NOT NULL"), ["event_type"], "value", "ts", F.col("value") >= 50)


@query(
    """WITH a AS (SELECT event_type, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY event_type), b AS (SELECT event_type, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY event_type)
SELECT event_type, round(a.v, 6) AS a, round(b.v, 6) AS b, round(b.v - a.v, 6) AS diff, round((b.v - a.v) / a.v * 100, 6) AS percent FROM a FULL JOIN b USING (event_type)"""
)
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' means side by side; events of even and odd ids stand for two runs."""
    e = table(spark, sf_dir, "events")
    m = lambda r: e.filter(F.col("event_id") % 2 == r).groupBy("event_type").agg(F.avg("value").alias("v"))
    x = E.compare(m(0), m(1), "event_type", "v")
    return x.select("event_type", *[F.round(c, 6).alias(c) for c in ("a", "b", "diff", "percent")])


@query(
    f"""WITH q AS (SELECT item_id, lower(array_to_string(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), ' ')) AS q FROM benchmark)
SELECT item_id, list_sort(list_distinct(list_concat([q], list_filter(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 3)))) AS terms FROM q"""
)
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms of each benchmark item as a query."""
    q = F.array_join(T.words(T.text_of("text")), " ")
    return table(spark, sf_dir, "benchmark").select("item_id", S.expand(q).alias("terms"))


_ASKED = "the that of with"
_TERMS = "['that', 'the that of with', 'with']"


@query(
    rf"""WITH x AS (SELECT doc_id, lower(text) AS low, {STRIP.format('text')} AS t FROM documents), y AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, ' ' || regexp_replace(low, '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+', '  ', 'g') || ' ' AS plain FROM x),
z AS (SELECT *, length(t) < 150 AND len(string_split(t, chr(10))) <= 2 AND len(list_filter(w, lambda v: regexp_matches(v, '^(?:\p{{Lu}}|[^\p{{L}}])')))::DOUBLE / greatest(len(w), 1) > 0.8 AS heading,
  list_sum(list_transform({_TERMS}, lambda v: least(3, floor((length(plain) - length(replace(plain, ' ' || v || ' ', ''))) / (length(v) + 2))))) AS hits FROM y)
SELECT doc_id, round(greatest(least(CASE WHEN contains(low, '{_ASKED}') THEN 0.08 + 0.05 ELSE 0 END + least(hits * 0.02, 0.05) + CASE WHEN heading AND length(t) < 50 THEN -0.30 WHEN heading THEN -0.20 ELSE 0 END, 0.15), -0.30)::DOUBLE, 6) AS boost FROM z"""
)
def keyword_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword boost of every document for one query."""
    q = F.lit(_ASKED)
    return docs(spark, sf_dir).select("doc_id", F.round(S.keyword_boost(F.col("text"), S.expand(q), q), 6).alias("boost"))


@query(
    r"""WITH n AS (SELECT source, doc_id, text, lower(array_to_string(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), ' ')) AS n FROM documents WHERE text <> ''),
d AS (SELECT *, row_number() OVER (PARTITION BY source, n ORDER BY doc_id) AS d FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM d WHERE d = 1),
t AS (SELECT *, greatest(1, length(text) // 4) AS tokens FROM k WHERE k <= 10), r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM t)
SELECT source, doc_id, tokens::INTEGER AS tokens, total::BIGINT AS total_tokens, place::INTEGER AS place FROM r WHERE total <= 3000 OR place = 1"""
)
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context of up to ten different documents and 3,000 tokens for each source."""
    x = docs(spark, sf_dir).select("source", "doc_id", "text")
    return S.context_window(x, ["source"], "text", 10, 3000, ["doc_id"], ["doc_id"]).select("source", "doc_id", "tokens", "total_tokens", "place")


@query(
    """SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') OR doc_id IN (7, 11) OR (contains(lower(lang), 'e') AND contains('es,en', lower(lang)) AND lang = 'es')"""
)
def access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a user with rules on two products, two documents and a field may see."""
    rules = [("u", "index", "src1, src2", None, None), ("u", "document", None, "7, 11", None), ("u", "field", None, None, "ES"), ("v", "full", None, None, None)]
    acls = spark.createDataFrame(rules, "user_id string, access_type string, index_scope string, doc_scope string, field_scope string")
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("product_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("lang").alias("field_name"))
    return S.visible(p, acls, "u").select(F.col("chunk_id").alias("doc_id"))


@query(
    """WITH s AS (SELECT source || CASE WHEN doc_id % 2 = 0 THEN '.json' ELSE '' END AS file, doc_id AS chunk_id, lang AS section, n_chars / 1000.0::DOUBLE AS score FROM documents WHERE doc_id % 3 = 0),
c AS (SELECT file, chunk_id, max(score) AS s FROM s GROUP BY ALL), t AS (SELECT file, section, max(score) AS s FROM s GROUP BY ALL), o AS (SELECT chunk_id, max(score) AS s FROM s GROUP BY ALL), f AS (SELECT file, max(score) AS s FROM s GROUP BY ALL)
SELECT d.doc_id AS chunk_id, d.source AS file, d.lang AS section, coalesce(c0.s, c1.s, t1.s, c2.s, t2.s, c3.s, t3.s, o.s, t0.s, f.s, 0.0) AS trust FROM documents d
LEFT JOIN c c0 ON c0.file = d.source AND c0.chunk_id = d.doc_id LEFT JOIN c c1 ON c1.file = d.source || '.jsonl' AND c1.chunk_id = d.doc_id LEFT JOIN c c2 ON c2.file = d.source || '.json' AND c2.chunk_id = d.doc_id LEFT JOIN c c3 ON c3.file = d.source || '.txt' AND c3.chunk_id = d.doc_id
LEFT JOIN t t0 ON t0.file = d.source AND t0.section = d.lang LEFT JOIN t t1 ON t1.file = d.source || '.jsonl' AND t1.section = d.lang LEFT JOIN t t2 ON t2.file = d.source || '.json' AND t2.section = d.lang LEFT JOIN t t3 ON t3.file = d.source || '.txt' AND t3.section = d.lang
LEFT JOIN o ON o.chunk_id = d.doc_id LEFT JOIN f ON f.file = d.source"""
)
def score_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of chunks by the closest key that has one; a third of the documents is scored, half of those under another name of their file."""
    d = table(spark, sf_dir, "documents")
    name = F.concat("source", F.when(F.col("doc_id") % 2 == 0, ".json").otherwise(""))
    s = d.filter("doc_id % 3 = 0").select(name.alias("file"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("section"), (F.col("n_chars") / 1000.0).alias("score"))
    return S.score_cascade(d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file"), F.col("lang").alias("section")), s)


@query()
def approximate_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 20 by an index of all vectors, and beside each query's rows the share of the true ten (`nearest`) among them."""
    e = table(spark, sf_dir, "embeddings")
    where = workspace(spark, "ivf")
    IV.build(e, where, dim=64)
    asked = e.filter("vec_id % 20 = 0")
    found = IV.search(spark, where, asked, 10, probes=IV.probes_for(spark, where, asked, 10))
    hits = nearest(spark, sf_dir).select("query_id", "id").join(found.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg((F.count(F.lit(1)) / 10).alias("recall"))
    return found.join(hits, "query_id", "left").select("query_id", "rank", "id", F.round("score", 6).alias("score"), F.coalesce("recall", F.lit(0.0)).alias("recall"))
