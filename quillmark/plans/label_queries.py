"""Queries that label texts and check items against rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as K
from ..functions import text as T
from ..operators import quality as Q
from ..session import small_batches, table
from .registry import query
from .text_queries import NW, STRIP, dealt_docs, docs


_AUD = ", ".join(f"({{'s': len(regexp_extract_all(low, '{p}')), 'o': {-i}, 'n': '{n}'}})" for i, (n, p) in enumerate(K.AUDIENCES.items()))


@query(f"SELECT doc_id, (SELECT CASE WHEN m.s > 0 THEN m.n ELSE 'general' END FROM (SELECT list_max([{_AUD}]) AS m)) AS audience FROM (SELECT doc_id, lower(source || ' ' || text) AS low FROM documents)")
def audiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a document is written for; its source stands for its section."""
    return docs(spark, sf_dir).select("doc_id", K.audience(F.col("text"), F.col("source")).alias("audience"))


def _count_sql(terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"(length(low) - length(replace(low, '{t}', ''))) / {len(t)}" for t in terms) + ")"


SQL_ROUTE = f"""SELECT doc_id, CASE WHEN {_count_sql(K.MEDICAL_WORDS)} >= 2 OR regexp_matches(low, '{'|'.join(K.MEDICAL_PHRASES)}') THEN 'MEDICAL'
  WHEN regexp_matches(low, '{'|'.join(K.BANKING_WORDS)}') AND ({_count_sql(K.BANKING_WORDS)} >= 3 OR regexp_matches(low, '{'|'.join(K.BANKING_PHRASES)}')) THEN 'FINANCIAL' WHEN regexp_matches(low, '{'|'.join(K.REGULATORY_WORDS)}') THEN 'REGULATORY' ELSE 'TECH' END AS playbook
FROM (SELECT doc_id, lower(text) || ' ' || chr(10) || ' ' || lower(source) AS low FROM documents)"""


@query(SQL_ROUTE)
def playbook_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The playbook that a document is routed to."""
    return docs(spark, sf_dir).select("doc_id", K.route(F.col("text"), F.col("source")).alias("playbook"))


def _count_sql(kind: str) -> str:
    return " + ".join("len(regexp_extract_all(text, '(?im)" + p.replace("'", "''") + "'))" for p in K.KINDS[kind])


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_LOGN = "ln(9)"
_SCORE = (
    "CASE WHEN n_{k} = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, least(1.0, ln(1 + n_{k}) / " + _LOGN + ") * 0.6::DOUBLE + least(1.0, n_{k} / greatest(w / 1000.0::DOUBLE, 1.0) / 1.5::DOUBLE) * 0.4::DOUBLE"
    " + CASE WHEN n_{k} >= 3 THEN least(0.15::DOUBLE, (n_{k} - 3) * 0.02::DOUBLE) ELSE 0 END) END"
)
_SAID = ", ".join(f"list_transform(regexp_extract_all(text, '(?i){p}'), lambda m: substr(trim(m), 1, 80))" for p in K.CLINICAL)
_ORDER = list(K.KINDS)
_SPEC = {k: len(K.SPECIAL) - K.SPECIAL.index(k) for k in _ORDER}
_KINDS_SQL = f"""WITH c AS (SELECT doc_id, text, {NW} AS w, doc_id % 3 AS m, {', '.join(f'{_count_sql(k)} AS n_{k}' for k in _ORDER)},
  list_filter({_list(K.MEDICAL_KEYWORDS)}, lambda x: contains(lower(text), x)) AS kw, list_filter({_list(K.MEDICAL_SUBJECTS)}, lambda x: contains(lower(text), x)) AS sb, flatten([{_SAID}]) AS said FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
d AS (SELECT *, least(50, len(list_distinct(list_concat(list_concat(kw, sb), said)))) AS terms, CASE WHEN len(kw) > 0 THEN round_even(least(0.25::DOUBLE, 0.05::DOUBLE + len(kw) * 0.015::DOUBLE), 3) ELSE 0.0::DOUBLE END AS key FROM c),
e AS (SELECT *, terms / greatest(w / 1000.0::DOUBLE, 0.1::DOUBLE) AS density, round_even(terms / greatest(w / 1000.0::DOUBLE, 0.1::DOUBLE), 3) AS dense,
  CASE m WHEN 0 THEN 'code' WHEN 1 THEN 'documentation' END AS pk, CASE m WHEN 0 THEN 0.35::DOUBLE WHEN 1 THEN 0.25::DOUBLE END AS ps FROM d),
s1 AS (SELECT *, {', '.join((f"CASE WHEN n_{k} > 0 THEN least(1.0::DOUBLE, {_SCORE.format(k=k)} + key + least(0.25::DOUBLE, terms * 0.015::DOUBLE + dense * 0.02::DOUBLE)) WHEN terms > 0 THEN least(1.0::DOUBLE, key + least(0.25::DOUBLE, terms * 0.015::DOUBLE + density * 0.02::DOUBLE)) ELSE 0.0::DOUBLE END" if k == 'medical' else f"CASE WHEN n_{k} > 0 THEN {_SCORE.format(k=k)} WHEN pk = '{k}' THEN ps ELSE 0.0::DOUBLE END") + f' AS s_{k}' for k in _ORDER)} FROM e),
s2 AS (SELECT * REPLACE (CASE WHEN dense >= 5 AND s_regulatory > 0 THEN round_even(s_regulatory * 0.6::DOUBLE, 3) ELSE s_regulatory END AS s_regulatory, CASE WHEN key >= 0.10 AND s_technical > 0 THEN round_even(s_technical * 0.6::DOUBLE, 3) ELSE s_technical END AS s_technical),
  key >= 0.10 AND s_medical > 0 AND s_medical < 0.5 AND s_legal = 0 AS boosted FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN boosted THEN least(1.0::DOUBLE, s_medical + 0.12::DOUBLE) ELSE s_medical END AS s_medical, CASE WHEN s_legal > 0 THEN least(1.0::DOUBLE, s_legal + 0.15::DOUBLE) ELSE s_legal END AS s_legal) FROM s2),
r AS (SELECT *, list_sort(list_filter([{', '.join(f"{{'s': -s_{k}, 'o': CASE WHEN pk = '{k}' THEN -2 WHEN terms > 0 AND '{k}' = 'medical' THEN -1 ELSE {i} END, 'k': '{k}', 'p': {_SPEC[k]}}}" for i, k in enumerate(_ORDER))}], lambda x: x.s < 0)) AS q FROM s3),
t AS (SELECT *, q[1] AS a, q[2] AS b, list_filter(q, lambda x: x.k = 'medical')[1] AS md, coalesce(q[2].s - q[1].s, 9.0::DOUBLE) AS near FROM r),
u AS (SELECT *, CASE WHEN coalesce(-md.s >= 0.75 AND a.k <> 'medical' AND md.s - a.s <= 0.05, FALSE) THEN md WHEN dense >= 5 AND near < 0.02 AND a.k = 'regulatory' AND coalesce(b.k IN ('academic', 'medical'), FALSE) THEN b
  WHEN key >= 0.10 AND a.k = 'technical' AND near < 0.08 AND coalesce(b.k IN ('academic', 'medical'), FALSE) THEN b WHEN near < 0.02 AND coalesce(b.p > a.p, FALSE) THEN b ELSE a END AS best FROM t),
v AS (SELECT *, coalesce(best.k, 'general') AS kind, n_s, CASE WHEN wm > 30 THEN 1.2::DOUBLE WHEN wm < 15 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS f FROM (SELECT *, len(regexp_extract_all(regexp_replace(text, '[.!?]+', ' ', 'g'), '[^\\x20\\x09-\\x0D]+'))::DOUBLE / greatest(n_s, 1) AS wm FROM (
  SELECT *, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS n_s FROM u))),
z AS (SELECT v.*, floor(c0 * f) AS z1, floor(c1 * f) AS o1, c2, c3, strategy FROM v JOIN (VALUES {', '.join(f"('{k}', {x[0]}, {x[1]}, {x[2]}, {x[3]}, '{x[4]}')" for k, x in K.SETUPS.items())}) AS cfg(k, c0, c1, c2, c3, strategy) ON cfg.k = v.kind),
y AS (SELECT *, CASE WHEN w < 100 THEN least(z1, w * 4) WHEN w > 10000 THEN floor(z1 * 1.1::DOUBLE) ELSE z1 END AS z2 FROM z),
x AS (SELECT *, CASE WHEN w < 100 THEN least(o1, floor(z2 / 4)) WHEN w > 10000 THEN floor(o1 * 1.1::DOUBLE) ELSE o1 END AS o2, greatest(c2, least(z2, c3)) AS z3 FROM y)
SELECT doc_id, kind, CASE WHEN len(q) = 0 THEN 0.3::DOUBLE ELSE round(-best.s, 6) END AS confidence, CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE round(b.s - best.s, 6) END AS gap,
  CASE WHEN len(q) = 0 THEN ['general'] ELSE list_transform(q[1:3], lambda c: c.k) END AS candidates, dense AS density, boosted, z3::INTEGER AS size, least(o2, z3 - 1)::INTEGER AS overlap, strategy FROM x"""


@query(_KINDS_SQL)
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of content of each document with the evidence, and the chunking setup for it; ids stand for file names, the hint is legal."""
    t, m = F.col("text"), F.col("doc_id") % 3
    x = small_batches(dealt_docs(spark, sf_dir)).withColumn("file", F.concat(F.col("doc_id").cast("string"), F.when(m == 0, ".py").when(m == 1, ".MD").otherwise(".pdf")))
    x = x.select("doc_id", K.prior(F.col("file")).alias("prior"), K.evidence(t).alias("e"))
    x = x.withColumn("c", K.detect({k: F.col("e")[k] for k in K.KINDS}, F.col("e.words"), F.col("e.keywords"), F.col("e.terms"), F.col("prior"), F.lit("legal")))
    x = x.withColumn("s", K.setup_by(F.col("c.kind"), F.col("e")))
    return x.select("doc_id", "c.kind", "c.confidence", "c.gap", F.transform("c.candidates", lambda v: v["kind"]).alias("candidates"), "c.density", "c.boosted", "s.*")


@query(
    """WITH f AS (SELECT doc_id, source, lang, CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.md' WHEN 2 THEN '.txt' ELSE '.bin' END AS ext FROM documents),
p AS (SELECT *, CASE ext WHEN '.pdf' THEN 3 WHEN '.md' THEN 2 WHEN '.txt' THEN 1 ELSE 0 END AS prio, lower('D' || doc_id || ext) AS name FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY prio DESC, name) AS r FROM p)
SELECT doc_id, source, name, prio FROM r WHERE r <= 2 ORDER BY prio DESC, name, doc_id LIMIT 5"""
)
def sampled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five files to look at, two of a source at most, by extension and name; the limit is the feature."""
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".md", ".txt", ".bin"))), (F.col("doc_id") % 4 + 1).cast("int"))
    name = F.lower(F.concat(F.lit("D"), F.col("doc_id").cast("string"), ext))
    x = table(spark, sf_dir, "documents").select("doc_id", "source", name.alias("name"), (3 - F.col("doc_id") % 4).cast("int").alias("prio"))
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("prio"), "name"))
    return x.withColumn("r", r).filter("r <= 2").orderBy(F.desc("prio"), "name", "doc_id").limit(5).drop("r")


_VIOLATIONS = """WITH i AS (SELECT doc_id, text, source, CASE WHEN doc_id % 10 = 0 THEN '' ELSE lang END AS lang, 'f' || doc_id || CASE doc_id % 7 WHEN 0 THEN '.EXE' ELSE '.txt' END AS source_path, n_chars AS file_size,
  CASE WHEN doc_id % 9 = 0 THEN 'soon' ELSE strftime(DATE '2024-01-01' + (doc_id % 400)::INT, '%Y-%m-%dT%H:%M:%SZ') END AS created_at FROM documents),
v AS (SELECT * FROM (SELECT 'required_fields:lang' AS rule, 'error' AS severity, count_if(trim(coalesce(lang, '')) = '') AS affected, count(*) AS total FROM i
UNION ALL SELECT 'required_fields:source', 'error', count_if(trim(coalesce(source, '')) = ''), count(*) FROM i
UNION ALL SELECT 'bad_extensions', 'error', count_if(source_path LIKE '%.EXE'), count(*) FROM i
UNION ALL SELECT 'min_freshness', 'warning', count_if(coalesce(try_cast(created_at AS TIMESTAMPTZ) < TIMESTAMPTZ '2025-01-01 00:00:00+00' - INTERVAL 180 DAYS, TRUE)), count(*) FROM i
UNION ALL SELECT 'file_size:under', 'warning', count_if(file_size < 100), count(*) FROM i UNION ALL SELECT 'file_size:over', 'warning', count_if(file_size > 20000), count(*) FROM i
UNION ALL SELECT 'content_length:under', 'error', count_if(length(text) < 50), count(*) FROM i) WHERE affected > 0
UNION ALL SELECT 'max_duplicate_rate', 'error', count(*) - count(DISTINCT text), count(*) FROM i HAVING (count(*) - count(DISTINCT text)) / count(*) > 0.01)
SELECT rule, severity, affected::BIGINT AS affected, total::BIGINT AS total FROM v"""


@query(_VIOLATIONS)
def dq_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the documents break as items with paths, sizes and dates."""
    return _violations(spark, sf_dir)


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = docs(spark, sf_dir), F.col("doc_id")
    items = d.select(
        "text", "source", F.when(i % 10 == 0, "").otherwise(F.col("lang")).alias("lang"), F.concat(F.lit("f"), i.cast("string"), F.when(i % 7 == 0, ".EXE").otherwise(".txt")).alias("source_path"), F.col("n_chars").alias("file_size"),
        F.when(i % 9 == 0, "soon").otherwise(F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (i % 400).cast("int")).cast("string"), F.lit("T00:00:00Z"))).alias("created_at"),
    )
    rules = Q.Rules(("lang", "source"), 0.01, None, ("exe",), 180, (100, 20000), (50, None), {"min_freshness": "warning", "file_size": "warning"})
    return Q.violations(items, rules, F.lit("2025-01-01T00:00:00Z").cast("timestamp"))


@query(
    f"""SELECT count(*) AS violations, count_if(severity = 'error')::BIGINT AS errors, count_if(severity = 'warning')::BIGINT AS warnings,
  round(greatest(0.0, 1 - (2 * coalesce(sum(affected) FILTER (severity = 'error'), 0) + coalesce(sum(affected) FILTER (severity = 'warning'), 0))::DOUBLE / greatest(1, 2 * max(total))), 6) AS quality FROM ({_VIOLATIONS})"""
)
def dq_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by severity and the quality score."""
    return Q.report(_violations(spark, sf_dir))


@query(f"SELECT lang, count(*) AS docs, count_if({NW} < 50)::BIGINT AS under_min_tokens, count_if({STRIP.format('text')} = '')::BIGINT AS empty, count_if(lang IS NULL)::BIGINT AS no_lang FROM documents GROUP BY lang")
def dq_recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommended checks by language: least words, text at all, a language."""
    t = F.col("text")
    return docs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(T.n_words(t) < 50).alias("under_min_tokens"), F.count_if(T.stripped(t) == "").alias("empty"), F.count_if(F.col("lang").isNull()).alias("no_lang"))
