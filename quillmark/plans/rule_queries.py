"""Queries over settings, advice, causes of failures and the readiness of embeddings. Their SQL spells the expected rules out and doesn't read the tables of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import advice as AD
from ..operators import settings as ST
from ..operators import vectors as V
from ..session import table
from . import config as C
from .registry import query
from .score_queries import _FP, _PII, _SCORED, fingerprint, scored

_KINDS = """('legal', 1200, 240, 200, 2000, 'semantic'), ('medical', 800, 160, 100, 1200, 'semantic'), ('regulatory', 1400, 280, 200, 2200, 'semantic'), ('finance_banking', 1300, 260, 200, 2000, 'semantic'), ('code', 900, 180, 100, 1500, 'recursive'),
  ('documentation', 800, 160, 100, 1500, 'paragraph_boundary'), ('conversation', 700, 140, 50, 1200, 'sentence_boundary'), ('academic', 1200, 240, 150, 2000, 'semantic'), ('technical', 800, 160, 100, 1500, 'semantic'), ('general', 1000, 200, 100, 2000, 'fixed_size')"""
_BOOKS = """('ACADEMIC', 4000, 250, 'semantic'), ('ECOMMERCE', 3200, 150, 'fixed_size'), ('FINANCIAL', 6000, 350, 'semantic'), ('HEALTHCARE', 4800, 300, 'semantic'), ('LEGAL', 7200, 400, 'semantic'), ('MEDICAL', 3200, 640, 'semantic'),
  ('REGULATORY', 3600, 300, 'semantic'), ('RETAIL', 3600, 200, 'fixed_size'), ('SCANNED', 3600, 300, 'semantic'), ('TECH', 3200, 240, 'semantic')"""
_STATES = (("f", "F"), ("o", "O"), ("p", "P"))
_PRIORITIES = (("size", "1-URGENT"), ("overlap", "2-HIGH"), ("least", "3-MEDIUM"), ("strategy", "4-NOT SPECIFIED"), ("kind", "5-LOW"))
_WIDE = ", ".join(f"max(CASE WHEN s = '{st}' AND p = '{pr}' THEN v END) AS {a}_{b}" for a, st in _STATES for b, pr in _PRIORITIES)


def _picked(f: str, zero: str | None = None) -> str:
    """The one layer of rank 4: what the run resolved, what the product resolved, or its stored fields."""
    some = (lambda c: f"nullif({c}, {zero})") if zero else (lambda c: c)
    return f"CASE pick WHEN 'run' THEN {some('o_' + f)} WHEN 'own' THEN {some('f_' + f)} WHEN 'stored' THEN p_{f} END"


@query(
    f"""WITH o AS (SELECT o_custkey AS id, o_orderstatus AS s, o_orderpriority AS p, max(trunc(o_totalprice)::INT % 4000) AS v FROM orders GROUP BY ALL),
w AS (SELECT id, {_WIDE} FROM o GROUP BY id),
w2 AS (SELECT * REPLACE ({', '.join(f"CASE WHEN {a}_strategy % 2 = 0 THEN 'recursive' WHEN {a}_strategy IS NOT NULL THEN '' END AS {a}_strategy, CASE WHEN {a}_kind IS NOT NULL THEN 'medical' END AS {a}_kind" for a, _ in _STATES)}) FROM w),
c AS (SELECT c_custkey AS product_id, c_nationkey AS nk, c_mktsegment AS seg, c_acctbal AS bal, c_custkey % 3 <> 0 AS forced, c_acctbal > 5000 AS met, c_nationkey % 4 <> 0 AS auto,
  CASE WHEN c_acctbal > 9500 THEN 'health-care' END AS run_book, CASE WHEN c_acctbal < 0 THEN 'FINANCIAL' END AS found_book, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Retail' WHEN 'MACHINERY' THEN 'tech' WHEN 'AUTOMOBILE' THEN 'e-commerce' WHEN 'BUILDING' THEN 'Poems' END AS own_book,
  CASE c_nationkey % 6 WHEN 0 THEN 'legal' WHEN 1 THEN 'code' WHEN 2 THEN 'scanned' WHEN 4 THEN 'poem' END AS kind FROM customer),
b AS (SELECT *, coalesce(run_book, found_book, own_book, 'TECH') AS playbook_id, CASE WHEN run_book IS NOT NULL THEN 'run_conf' WHEN found_book IS NOT NULL THEN 'detected_playbook' WHEN own_book IS NOT NULL THEN 'product' ELSE 'global_default' END AS playbook_from FROM c),
k AS (SELECT b.*, coalesce(q.book, 'TECH') AS book FROM b LEFT JOIN (VALUES {_BOOKS}) AS q(book, z, y, x) ON q.book = regexp_replace(upper(playbook_id), '[^A-Z0-9]', '', 'g')),
j AS (SELECT k.*, coalesce(kind, CASE WHEN book = 'RETAIL' THEN 'conversation' END, 'general') AS base, CASE WHEN kind IS NOT NULL THEN 'product_auto_settings' WHEN book = 'RETAIL' THEN 'playbook' ELSE 'global_default' END AS base_from FROM k),
m AS (SELECT j.*, w2.* EXCLUDE (id), bk.* EXCLUDE (book), kd.* EXCLUDE (kind), CASE WHEN seg = 'FURNITURE' AND bal >= 1 THEN trunc(bal)::INT END AS hand_size, CASE WHEN NOT forced THEN 'none' WHEN o_size IS NOT NULL THEN 'run' WHEN auto AND (f_size IS NOT NULL OR met) THEN 'own' ELSE 'stored' END AS pick
  FROM j LEFT JOIN w2 ON w2.id = product_id JOIN (VALUES {_BOOKS}) AS bk(book, b_size, b_overlap, b_strategy) ON bk.book = j.book LEFT JOIN (VALUES {_KINDS}) AS kd(kind, k_size, k_overlap, k_least, k_most, k_strategy) ON kd.kind = base),
x AS (SELECT *, CASE WHEN pick = 'stored' THEN 'force_product_chunking_config' ELSE 'resolved_settings' END AS label, {_picked('size', '0')} AS g_size, {_picked('overlap')} AS g_overlap, {_picked('least', '0')} AS g_least, {_picked('strategy', "''")} AS g_strategy, {_picked('kind', "''")} AS g_kind,
  CASE WHEN nk % 7 = 1 THEN 5000 END AS run_overlap, CASE WHEN nk % 7 = 0 THEN 3000 END AS run_most FROM m),
y AS (SELECT *, coalesce(g_size, hand_size, k_size, b_size) AS size, coalesce(run_overlap, g_overlap, k_overlap, b_overlap) AS overlap FROM x)
SELECT product_id, playbook_id, playbook_from, size AS chunk_size, CASE WHEN g_size IS NOT NULL THEN label WHEN hand_size IS NOT NULL THEN 'product_manual_settings' WHEN k_size IS NOT NULL THEN 'content_type_defaults' ELSE 'playbook_defaults' END AS chunk_size_from,
  CASE WHEN overlap >= size THEN greatest(0, size - 1) ELSE overlap END AS chunk_overlap, CASE WHEN overlap >= size THEN 'guard' WHEN run_overlap IS NOT NULL THEN 'run_conf' WHEN g_overlap IS NOT NULL THEN label WHEN k_overlap IS NOT NULL THEN 'content_type_defaults' ELSE 'playbook_defaults' END AS chunk_overlap_from,
  coalesce(g_least, k_least, 100) AS min_chunk_size, CASE WHEN g_least IS NOT NULL THEN label WHEN k_least IS NOT NULL THEN 'content_type_defaults' ELSE 'global_default' END AS min_chunk_size_from,
  coalesce(run_most, k_most, 2000) AS max_chunk_size, CASE WHEN run_most IS NOT NULL THEN 'run_conf' WHEN k_most IS NOT NULL THEN 'content_type_defaults' ELSE 'global_default' END AS max_chunk_size_from,
  coalesce(g_strategy, k_strategy, b_strategy) AS chunking_strategy, CASE WHEN g_strategy IS NOT NULL THEN label WHEN k_strategy IS NOT NULL THEN 'content_type_defaults' ELSE 'playbook_defaults' END AS chunking_strategy_from,
  CASE WHEN coalesce(g_kind, CASE WHEN book = 'RETAIL' THEN 'conversation' END, base) = 'scanned' THEN 'general' ELSE coalesce(g_kind, CASE WHEN book = 'RETAIL' THEN 'conversation' END, base) END AS content_type,
  CASE WHEN g_kind IS NOT NULL AND pick <> 'stored' THEN 'resolved_settings' ELSE base_from END AS content_type_from, CASE nk % 3 WHEN 0 THEN 'scanned_ocr' WHEN 1 THEN 'mixed' ELSE 'native_pdf' END AS source_quality FROM y"""
)
def resolved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field's value and layer for each product: customers stand for products, and the states and priorities of their orders for what runs and products have settled."""
    c, nk, bal, seg = table(spark, sf_dir, "customer"), F.col("c_nationkey"), F.col("c_acctbal"), F.col("c_mktsegment")
    pick = lambda on, m: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), on)
    products = c.select(
        F.col("c_custkey").alias("product_id"), F.when(bal > 9500, "health-care").when(bal > 9000, "").alias("run_playbook"), F.when(bal < 0, "FINANCIAL").alias("detected_playbook"),
        pick(seg, {"HOUSEHOLD": "Retail", "MACHINERY": "tech", "AUTOMOBILE": "e-commerce", "BUILDING": "Poems"}).alias("playbook"), pick(nk % 6, {0: "legal", 1: "code", 2: "scanned", 3: "", 4: "poem"}).alias("kind"),
        pick(nk % 3, {0: " Scanned_PDF", 1: "mixed", 2: "digital_pdf"}).alias("extraction_type"), pick(nk % 4, {0: "manual", 1: "auto"}).alias("mode"), (F.col("c_custkey") % 3 != 0).alias("forced"), (bal > 5000).alias("confidence_met"),
    )
    row = lambda layer, field, value: F.struct(F.lit(layer).alias("layer"), F.lit(field).alias("field"), value.cast("string").alias("value"))
    said = F.array(
        row("manual", "chunk_size", F.when((seg == "FURNITURE") & (bal >= 1), bal.cast("int"))), row("manual", "chunk_overlap", F.when(seg == "BUILDING", "many")),
        row("run", "max_chunk_size", F.when(nk % 7 == 0, 3000)), row("run_direct", "chunk_overlap", F.when(nk % 7 == 1, 5000)), row("run", "color", F.lit("red")),
    )
    own = c.select(F.col("c_custkey").alias("product_id"), F.inline(said))
    fields = {"1-URGENT": "chunk_size", "2-HIGH": "chunk_overlap", "3-MEDIUM": "min_chunk_size", "4-NOT SPECIFIED": "chunking_strategy", "5-LOW": "content_type"}
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("product_id"), "o_orderstatus", "o_orderpriority").agg(F.max(F.col("o_totalprice").cast("int") % 4000).alias("v"))
    o = o.select("product_id", pick(F.col("o_orderstatus"), {"F": "resolved", "O": "run_resolved", "P": "stored"}).alias("layer"), pick(F.col("o_orderpriority"), fields).alias("field"), "v")
    name = F.when(F.col("field") == "chunking_strategy", F.when(F.col("v") % 2 == 0, "recursive").otherwise("")).when(F.col("field") == "content_type", "medical").otherwise(F.col("v").cast("string"))
    books = ST.playbook_rows(spark, C.PLAYBOOKS).unionByName(spark.createDataFrame([("RETAIL", "content_type", "conversation")], "playbook string, field string, value string"))
    return ST.resolve_products(products, own.unionByName(o.select("product_id", "layer", "field", name.alias("value"))), books, ST.kind_rows(spark, C.SETUPS))


def _said(actions: Column) -> Column:
    """Each action as name[setting=value,...]priority, settings in order of their names."""
    one = lambda a: F.concat(a["action"], F.lit("["), F.array_join(F.transform(F.array_sort(F.map_entries(a["config"])), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), F.lit("]"), F.coalesce(a["priority"], F.lit("")))
    return F.transform(actions, one)


def _advised(x: DataFrame, *keys: str) -> DataFrame:
    x = AD.advise(x).withColumn("s", AD.apply_actions(F.col("actions"), F.lit(1000), F.lit(200), F.col("playbook")))
    return x.select(*keys, "bands", _said(F.col("actions")).alias("actions"), "tweaks", "playbooks", "next_playbook", F.col("s.chunk_overlap").alias("new_overlap"), F.col("s.playbook").alias("new_playbook"), F.col("s.error_correction").alias("error_correction"), F.col("s.extract_metadata").alias("extract_metadata"))


def _advice_sql(keys: str, source: str) -> str:
    """The rules of advice as a statement, over columns t (trust), c (completeness), k (knowledge base), m (metadata), s (secure), q (quality), playbook."""
    return f"""WITH f AS ({source}),
g AS (SELECT *, t >= 0.5 AND s >= 0.9 AND m >= 0.8 AND k >= 0.5 AS ok, coalesce(upper(playbook), '') <> 'TECH' AS other, playbook IS NULL OR upper(playbook) = 'REGULATORY' AS scan FROM f),
h AS (SELECT *, list_filter([
    CASE WHEN t < 0.5 THEN 'trust:below_threshold' WHEN t < 0.7 THEN 'trust:acceptable' WHEN t < 0.85 THEN 'trust:good' END, CASE WHEN s < 0.95 THEN 'security:good' WHEN s < 1 THEN 'security:excellent' END,
    CASE WHEN m < 0.8 THEN 'metadata:below_threshold' WHEN m < 0.85 THEN 'metadata:acceptable' WHEN m < 0.9 THEN 'metadata:good' END, CASE WHEN k < 0.5 THEN 'kb:below_threshold' WHEN k < 0.7 THEN 'kb:improvable' WHEN k < 0.85 THEN 'kb:good' END,
    CASE WHEN c < 0.6 THEN 'completeness:low' WHEN c < 0.75 THEN 'completeness:acceptable' WHEN c < 0.9 THEN 'completeness:good' END, CASE WHEN q < 0.7 THEN 'quality:low' WHEN q < 0.85 THEN 'quality:good' END,
    CASE WHEN NOT ok THEN 'policy:failed' WHEN t < 0.8 THEN 'policy:passed_below_0.8' WHEN t < 0.85 THEN 'policy:passed_below_0.85' END], lambda x: x IS NOT NULL) AS bands,
  list_filter([
    CASE WHEN t < 0.5 AND q < 0.7 THEN 'enhance_normalization[enable_advanced_cleaning=true,error_correction=true]high' END, CASE WHEN t < 0.5 AND c < 0.75 THEN 'increase_chunk_overlap[increase_by_percent=25,min_overlap=200]high' END,
    CASE WHEN t >= 0.5 AND t < 0.7 THEN 'apply_all_quality_improvements[enhance_normalization=true,error_correction=true,increase_overlap=true]medium' WHEN t >= 0.7 AND t < 0.85 THEN 'apply_all_quality_improvements[enhance_normalization=true,error_correction=true,extract_metadata=true]high' END,
    CASE WHEN m < 0.8 THEN 'extract_metadata[additional_fields=true,force_extraction=true]' WHEN m < 0.85 THEN 'extract_metadata[additional_fields=true]' END, CASE WHEN k < 0.7 AND other THEN 'switch_playbook[playbook_id=TECH]' END,
    CASE WHEN c < 0.6 AND scan THEN 'switch_playbook[playbook_id=SCANNED]' END, CASE WHEN c < 0.6 THEN 'increase_chunk_overlap[increase_by_percent=25,min_overlap=200]' WHEN c < 0.75 THEN 'increase_chunk_overlap[increase_by_percent=20,min_overlap=200]' END,
    CASE WHEN q < 0.7 THEN 'enhance_normalization[enable_advanced_cleaning=true,error_correction=true]high' WHEN q < 0.85 THEN 'enhance_normalization[enable_advanced_cleaning=true,error_correction=true]medium' END,
    CASE WHEN q < 0.7 THEN 'error_correction[enable_error_correction=true]high' WHEN q < 0.85 THEN 'error_correction[enable_error_correction=true]medium' END,
    CASE WHEN ok AND t < 0.8 THEN 'apply_all_quality_improvements[enhance_normalization=true,error_correction=true,extract_metadata=true,increase_overlap=' || (c < 0.8)::VARCHAR || ']high' WHEN ok AND t < 0.85 THEN 'apply_all_quality_improvements[enhance_normalization=true,error_correction=true,extract_metadata=true]high' END], lambda x: x IS NOT NULL) AS actions,
  list_filter([CASE WHEN m < 0.8 THEN 'force_metadata_extraction' END, CASE WHEN c < 0.75 THEN 'increase_chunk_overlap' END], lambda x: x IS NOT NULL) AS tweaks,
  list_filter([CASE WHEN k < 0.7 AND other THEN 'TECH' END, CASE WHEN c < 0.6 AND scan THEN 'SCANNED' END, CASE WHEN c < 0.6 AND scan THEN 'SCANNED' END], lambda x: x IS NOT NULL) AS playbooks, CASE WHEN c < 0.6 AND scan THEN 'SCANNED' ELSE playbook END AS next_playbook,
  CASE WHEN t < 0.5 AND c < 0.75 THEN 250 WHEN t >= 0.5 AND t < 0.7 THEN 250 ELSE 200 END AS o1, CASE WHEN c < 0.6 THEN 1.25::DOUBLE WHEN c < 0.75 THEN 1.2::DOUBLE ELSE 1::DOUBLE END AS up, ok AND t < 0.8 AND c < 0.8 AS last FROM g)
SELECT {keys}, CASE WHEN len(bands) + len(playbooks) = 0 THEN ['general:within_ranges'] ELSE bands END AS bands, actions, tweaks, playbooks, next_playbook, CASE WHEN last THEN least(floor(least(900, floor(o1 * up)) * 1.25), 400) ELSE least(900, floor(o1 * up)) END::INTEGER AS new_overlap,
  CASE WHEN c < 0.6 AND scan THEN 'SCANNED' WHEN k < 0.7 AND other THEN 'TECH' ELSE playbook END AS new_playbook, (t >= 0.5 AND t < 0.85) OR q < 0.85 OR (ok AND t < 0.85) AS error_correction, (t >= 0.7 AND t < 0.85) OR m < 0.85 OR (ok AND t < 0.85) AS extract_metadata FROM h"""


@query(_advice_sql("source", f"SELECT source, ai_trust AS t, completeness AS c, kb_ready AS k, metadata_completeness AS m, secure AS s, text_integrity AS q, CASE num_chunks % 3 WHEN 0 THEN 'Tech' WHEN 1 THEN 'regulatory' END AS playbook FROM ({_FP.replace('{key}', 'source')})"))
def advice_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to change for each source by its fingerprint, and its settings once all of it is done; text integrity is the quality of a text."""
    playbook = F.when(F.col("num_chunks") % 3 == 0, "Tech").when(F.col("num_chunks") % 3 == 1, "regulatory")
    return _advised(fingerprint(spark, sf_dir, "source").withColumn("quality", F.col("text_integrity")).withColumn("playbook", playbook), "source")


@query(
    _advice_sql(
        "doc_id",
        f"""SELECT doc_id, ai_trust AS t, round(completeness + 1e-9, 4) AS c, CASE WHEN w > 50 AND contains(text, chr(10)) THEN 1.0 ELSE 0.5 END AS k, round(metadata_completeness + 1e-9, 4) AS m, CASE WHEN {_PII} THEN 0.0 ELSE 1.0 END AS s, round(text_integrity + 1e-9, 4) AS q,
  CASE doc_id % 3 WHEN 0 THEN 'Tech' WHEN 1 THEN 'regulatory' END AS playbook FROM ({_SCORED})""",
    )
)
def advice_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each document, as if it were a product's only file."""
    t = F.col("text")
    x = scored(spark, sf_dir).select("doc_id", "ai_trust", S.secure(t).alias("secure"), S.kb_ready(t, F.col("w")).alias("kb_ready"), *[S.rounded(F.col(c)).alias(o) for c, o in (("completeness", "completeness"), ("metadata_completeness", "metadata_completeness"), ("text_integrity", "quality"))])
    return _advised(x.withColumn("playbook", F.when(F.col("doc_id") % 3 == 0, "Tech").when(F.col("doc_id") % 3 == 1, "regulatory")), "doc_id")


@query(
    """WITH d AS (SELECT conv_id, ['groundedness', 'citation_coverage', 'refusal_correctness', 'context_relevance', 'answer_relevance', 'latency'][(conv_id % 6 + 1)::INT] AS metric, count_if(role = 'assistant') AS yes, count_if(length(text) > 300) AS no, bool_or(turn >= 4) AS cut, count_if(contains(text, '[')) AS wrong, bool_or(contains(lower(text), 'cannot')) AS denied,
  count(*) * 400 AS size, max(turn) * 90 AS overlap, CASE WHEN conv_id % 2 = 0 THEN 'mpnet' END AS embedder FROM conversations GROUP BY conv_id),
c AS (SELECT *, CASE metric WHEN 'groundedness' THEN CASE WHEN no > yes THEN 'chunk_boundaries' WHEN cut THEN 'chunk_overlap' ELSE 'retrieval_quality' END WHEN 'citation_coverage' THEN CASE WHEN wrong > 0 THEN 'citation_format' ELSE 'chunk_boundaries' END
  WHEN 'refusal_correctness' THEN CASE WHEN denied THEN 'acl_config' ELSE 'prompt_template' END WHEN 'context_relevance' THEN 'embedding_model' WHEN 'answer_relevance' THEN 'embedding_model' ELSE 'unknown' END AS cause FROM d)
SELECT conv_id, metric, cause, CASE cause WHEN 'chunk_overlap' THEN 'increase_chunk_overlap' WHEN 'chunk_boundaries' THEN 'increase_chunk_size' WHEN 'embedding_model' THEN 'upgrade_embedding_model' WHEN 'acl_config' THEN 'review_acl_config' WHEN 'prompt_template' THEN 'update_prompt_template' ELSE 'review_pipeline' END AS action,
  CASE cause WHEN 'chunk_overlap' THEN 'chunk_overlap' WHEN 'chunk_boundaries' THEN 'chunk_size' WHEN 'embedding_model' THEN 'embedder_name' END AS setting,
  CASE cause WHEN 'chunk_overlap' THEN least(overlap + 100, 500)::VARCHAR WHEN 'chunk_boundaries' THEN least(size + 200, 2000)::VARCHAR WHEN 'embedding_model' THEN CASE WHEN embedder = 'mpnet' THEN 'e5-large' ELSE 'mpnet' END END AS value,
  CASE WHEN cause IN ('chunk_overlap', 'embedding_model', 'acl_config') THEN 'high' WHEN cause IN ('chunk_boundaries', 'prompt_template') THEN 'medium' ELSE 'low' END AS priority FROM c"""
)
def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may have caused a failed metric, by the details of its evaluation, and the setting that helps; conversations stand for evaluations, and features of their turns for the details."""
    t, name = F.col("text"), F.array(*[F.lit(m) for m in ("groundedness", "citation_coverage", "refusal_correctness", "context_relevance", "answer_relevance", "latency")])
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "assistant").alias("supported_claims"), F.count_if(F.length(t) > 300).alias("unsupported_claims"), F.max(F.col("turn") >= 4).alias("citation_issues"), F.count_if(F.contains(t, F.lit("["))).alias("invalid_citations"),
        F.max(F.contains(F.lower(t), F.lit("cannot"))).alias("acl_denied"), (F.count(F.lit(1)) * 400).alias("chunk_size"), (F.max("turn") * 90).alias("chunk_overlap"),
    )
    d = d.withColumn("metric", F.element_at(name, (F.col("conv_id") % 6 + 1).cast("int"))).withColumn("embedder", F.when(F.col("conv_id") % 2 == 0, "mpnet"))
    return AD.diagnose(d).select("conv_id", "metric", "cause", "action", "setting", "value", "priority")


@query(
    """WITH e AS (SELECT d.doc_id, v.embedding AS e, d.n_chars < 200 AS fb FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id),
n AS (SELECT e IS NOT NULL AS given, len(e) AS dim, sqrt(list_inner_product(e::DOUBLE[], e::DOUBLE[])) AS norm, coalesce(list_bool_or(list_transform(e, lambda v: isnan(v) OR isinf(v))), FALSE) AS bad, coalesce(list_bool_or(list_transform(e, lambda v: v <> 0)), FALSE) AS lit, coalesce(fb, FALSE) AS fb FROM e),
s AS (SELECT median(norm) AS median, stddev_pop(norm) AS sd, avg(norm) AS mean, count(norm) AS norms FROM n WHERE norm > 0 AND NOT bad),
c AS (SELECT count(*) AS attempted, count_if(given)::BIGINT AS produced, count_if(given AND dim <> 64)::BIGINT AS mismatched, count_if(fb)::BIGINT AS substitutes, count_if(NOT bad AND norm > 0 AND abs(norm - median) > 3 * sd)::BIGINT AS outliers, count_if(given AND NOT bad) AS valid, count_if(lit) AS non_zero, any_value(sd) AS sd, any_value(mean) AS mean, any_value(norms) AS norms FROM n, s),
h AS (SELECT *, CASE WHEN sd > 0 THEN 1 - outliers / norms ELSE 1 END AS nh, 1 - least(1, sd / mean / 0.75) AS steady, 100 - 100 * mismatched / attempted AS dims, 100 * produced / attempted AS success FROM c),
q AS (SELECT *, round(100 * (0.4 * valid / attempted + 0.3 * non_zero / attempted + 0.3 * nh) + 1e-9, 2) AS vqs, 100 * (0.3 * (1 - 3 / 200) + 0.25 * (1 - substitutes / attempted) + 0.2 * (1 - mismatched / attempted) + 0.15 * nh + 0.1 * steady) AS health FROM h)
SELECT attempted, produced, mismatched, substitutes, outliers, round(dims::DOUBLE + 1e-9, 2) AS dimension_consistency, round(success::DOUBLE + 1e-9, 2) AS success_rate, vqs AS vector_quality, round(health + 1e-9, 2) AS model_health, round(0.25 * dims + 0.35 * vqs + 0.25 * health + 0.15 * success + 1e-9, 2) AS semantic_readiness FROM q"""
)
def embedding_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well embedding the documents went, and whether the vectors are ready for search: documents are the attempts, short ones took a substitute, and three of two hundred calls failed."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    x = d.select("doc_id", (F.col("n_chars") < 200).alias("fb")).join(e.select("vec_id", "embedding"), F.col("vec_id") == F.col("doc_id"), "left")
    return V.readiness(x, "embedding", 64, "fb", requests=200, errors=3)
