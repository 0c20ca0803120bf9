"""Queries over chunk scores: metrics, fingerprints, policy, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring as S
from ..functions import text as T
from ..session import table
from .registry import query
from .text_queries import _LINES, _ODD, _PII, L, NW, R, STRIP, W, dealt_docs, docs

_SENT = f"len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: {STRIP.format('x')}), lambda x: x <> ''))"
_TS = f"length({STRIP.format('text')})"


def word_sql(low: str, terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"(contains({low}, '{t}') AND regexp_matches({low}, '{L}(?:{t}){R}'))::INT" for t in terms) + ")"


def _size_sql(t: str, a: int, b: int, c: int, d: int) -> str:
    return f"CASE WHEN {t} BETWEEN {c} AND {d} THEN 1.0 WHEN {t} >= {a} AND {t} < {c} THEN 0.7 + ({t} - {a})::DOUBLE / {c - a} * 0.3 WHEN {t} > {d} AND {t} <= {b} THEN 0.7 + ({b} - {t})::DOUBLE / {b - d} * 0.3 WHEN {t} < {a} THEN greatest(0.0, {t}::DOUBLE / {a} * 0.7) ELSE greatest(0.0, 0.7 * (1 - least(1.0, ({t} - {b})::DOUBLE / {b}))) END"


_TOK = f"floor({NW} * 1.3)"
_SIZE = _size_sql(_TOK, *S.SIZES["general"])
_Q = f"CASE WHEN {_TS} < 50 THEN 0.40 WHEN {NW} < 20 THEN 0.55 WHEN {_SENT} = 0 THEN 0.60 WHEN {NW} / {_SENT} < 5 THEN 0.60 WHEN {NW} / {_SENT} < 10 THEN 0.70 WHEN {NW} / {_SENT} <= 25 THEN 0.85 WHEN {NW} / {_SENT} <= 35 THEN 0.80 WHEN {NW} / {_SENT} <= 45 THEN 0.70 WHEN {NW} / {_SENT} <= 60 THEN 0.60 ELSE 0.50 END"
_DW = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+'))"
_DIV = f"CASE WHEN {_TS} < 20 OR len({_DW}) = 0 THEN 0.0 ELSE (SELECT CASE WHEN r < 0.3 THEN r / 0.3 * 0.5 WHEN r <= 0.7 THEN 0.5 + (r - 0.3) / 0.4 * 0.5 ELSE 1.0 END FROM (SELECT len(list_distinct({_DW}))::DOUBLE / len({_DW}) AS r)) END"
_KB = f"CASE WHEN {NW} > 50 AND contains(text, chr(10)) THEN 1.0 ELSE 0.5 END"
_CASTS = "{}::DOUBLE"


def with_facts(x: DataFrame) -> DataFrame:
    """Adds _w (words), _n (characters once stripped), _s (sentences) and token_est, each counted once; the optimiser doesn't put costly columns into
    the expressions that use them several times."""
    t = F.col("text")
    return x.withColumns({"_w": T.n_words(t), "_n": F.length(T.stripped(t)), "_s": F.size(T.sentences(t))}).withColumn("token_est", F.floor(F.col("_w") * 1.3).cast("int"))


@query(
    f"""SELECT doc_id, {_TOK}::INTEGER AS token_est, (CASE WHEN {NW} > 1000 THEN 1.0 ELSE 0.75 END)::DOUBLE AS completeness, (CASE WHEN {_TS} >= 50 THEN 1.0 ELSE 0.0 END)::DOUBLE AS parse_success,
  round(({_SIZE})::DOUBLE, 6) AS size_health, round(({_size_sql(_TOK, *S.SIZES['regulated'])})::DOUBLE, 6) AS size_health_regulated, (CASE WHEN {_PII} THEN 0.0 ELSE 1.0 END)::DOUBLE AS secure,
  ({_Q})::DOUBLE AS quality, round(({_DIV})::DOUBLE, 6) AS diversity, ({_KB})::DOUBLE AS kb_ready, 0.85::DOUBLE AS gpt_confidence FROM documents"""
)
def chunk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of each text that need no metadata."""
    t, tok, w, n, s = (F.col(c) for c in ("text", "token_est", "_w", "_n", "_s"))
    x = with_facts(docs(spark, sf_dir)).withColumn("_p", S.plain_words(t))
    x = x.withColumn("_d", F.when(F.size("_p") > 0, F.size(F.array_distinct("_p")) / F.size("_p")))
    return x.select(
        "doc_id", "token_est", S.completeness(t, w).alias("completeness"), S.parse_success(t, n=n).alias("parse_success"), F.round(S.size_health(tok), 6).alias("size_health"),
        F.round(S.size_health(tok, F.lit("legal")), 6).alias("size_health_regulated"), S.secure(t).alias("secure"), S.quality(t, w, s, n).alias("quality"), F.round(S.diversity(t, F.col("_d"), n), 6).alias("diversity"), S.kb_ready(t, w).alias("kb_ready"),
        S.gpt_confidence().alias("gpt_confidence"),
    )


_CON = "(" + " + ".join(f"contains(lower(text), '{p}')::INT" for p in (*S.CONNECTIVES, "furthermore")) + ")"


@query(
    rf"""SELECT doc_id, round((CASE WHEN {_TS} < 50 THEN 0.3 ELSE least(1.0, 0.4 + CASE WHEN contains(text, chr(10) || chr(10)) OR len(regexp_extract_all(text, '\n')) > 3 THEN 0.2 ELSE 0 END
  + CASE WHEN regexp_matches(text, '(?:^|\n)\s*[•\-\*\+]\s') OR regexp_matches(text, '(?:^|\n)\s*\d+[\.\)]\s') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(text, '{L}\d+(?:[.,]\d+)?(?:%|\$|USD|EUR|million|billion)?{R}') OR regexp_matches(text, '{L}\d+(?:[.,]\d+)?[%$][0-9A-Za-z_]') THEN 0.15 ELSE 0 END
  + CASE WHEN regexp_matches(lower(text), '{L}(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}){R}') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '{L}(?:see|refer|reference|section|chapter|page|table|figure)\s+\d+') THEN 0.1 ELSE 0 END
  + least({_CON} * 0.02, 0.15) + CASE WHEN regexp_matches(text, '{L}[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+{R}') THEN 0.1 ELSE 0 END + CASE WHEN {NW} > 100 THEN least(({NW} - 100) / 2000.0, 0.1) ELSE 0 END) END)::DOUBLE, 6) AS context_quality FROM documents"""
)
def context_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much context a text gives."""
    return docs(spark, sf_dir).select("doc_id", F.round(S.context_quality(F.col("text")), 6).alias("context_quality"))


def _intent_sql(domain: str | None) -> str:
    s = " + ".join(f"least({word_sql('low', terms)} * {points}, 0.5)" for terms, points in S.AUDIENCES)
    if domain:
        terms, points = S.DOMAINS[domain]
        s = f"least({word_sql('low', terms)} * {points}, 0.6) + ({s}) * CASE WHEN {word_sql('low', terms)} > 0 THEN 0.5 ELSE 1.0 END"
    s += f" + CASE WHEN regexp_matches(low, '{L}(?:you|your|users?|customers?|readers?|audience){R}') THEN 0.3 ELSE 0 END"
    s += f" + CASE WHEN regexp_matches(low, '{L}(?:for|intended\\s+for|designed\\s+for|targeted\\s+to)\\s+(?:the\\s+)?[0-9A-Za-z_]') THEN 0.2 ELSE 0 END"
    return f"round((CASE WHEN {_TS} < 20 THEN 0.0 ELSE least(1.0, {s}) END)::DOUBLE, 6)"


@query(f"SELECT doc_id, {_intent_sql(None)} AS general, {_intent_sql('regulatory')} AS regulatory, {_intent_sql('finance_banking')} AS finance FROM (SELECT doc_id, text, lower(text) AS low FROM documents)")
def audience_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How clearly a text addresses readers, in general and for two domains."""
    t = F.col("text")
    x = dealt_docs(spark, sf_dir).select("doc_id", S.audience_intents(t, (None, "regulatory", "finance_banking")).alias("s"))
    return x.select("doc_id", *[F.round(F.col("s")[i], 6).alias(n) for i, n in enumerate(("general", "regulatory", "finance"))])


@query(
    rf"""SELECT doc_id, lang AS audience, round((CASE WHEN {_SENT} = 0 THEN 0.7 ELSE least(1.0, 0.7 + CASE WHEN {NW} / {_SENT} BETWEEN 10 AND 20 THEN 0.15 WHEN {NW} / {_SENT} BETWEEN 8 AND 25 THEN 0.1 WHEN {NW} / {_SENT} BETWEEN 5 AND 30 THEN 0.05 ELSE 0 END) END)::DOUBLE, 6) AS accessibility,
  (CASE WHEN regexp_matches(lower(text), '{L}(?:simple|easy|clear|straightforward|basic|example|for instance|such as|including){R}') THEN 0.5 ELSE 0.3 END)::DOUBLE AS without_audience FROM documents"""
)
def audience_accessibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How readable a text is for its audience (here its language), and for none."""
    return docs(spark, sf_dir).select("doc_id", F.col("lang").alias("audience"), F.round(S.accessibility(F.col("text"), F.col("lang")), 6).alias("accessibility"), S.accessibility(F.col("text"), F.lit("")).alias("without_audience"))


@query(
    """SELECT o_orderkey, (CASE WHEN datediff('day', o_orderdate::DATE, DATE '1998-08-02') < 0 THEN 0.5 ELSE round(greatest(0.0, least(1.0, 1 - datediff('day', o_orderdate::DATE, DATE '1998-08-02') * 24.0 / 8760)), 6) END)::DOUBLE AS timeliness,
  (CASE WHEN o_orderstatus <> '' THEN 0.25 ELSE 0 END + 0.20 + CASE WHEN o_totalprice > 100000 THEN 0.15 ELSE 0 END + 0.15 + CASE WHEN o_orderpriority LIKE '1%' THEN 0.10 ELSE 0 END)::DOUBLE AS provenance,
  ((1 + (o_orderpriority <> '')::INT + (o_totalprice > 100000)::INT) / 4.0)::DOUBLE AS metadata FROM orders"""
)
def record_metadata_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeliness at a fixed date, provenance and metadata completeness; orders stand for records."""
    o, none = table(spark, sf_dir, "orders"), F.lit(None).cast("string")
    dear, first = F.when(F.col("o_totalprice") > 100000, "v"), F.when(F.col("o_orderpriority").startswith("1"), "t")
    return o.select(
        "o_orderkey", F.round(S.timeliness(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("1998-08-02")), 6).alias("timeliness"),
        S.provenance(F.col("o_orderstatus"), F.col("o_custkey"), dear, none, F.col("o_orderdate"), first).alias("provenance"), S.present(F.col("o_custkey"), F.col("o_orderpriority"), dear, none).alias("metadata"),
    )


#: The playbook of the test corpus: sections and fields that a record must have, rules of validity and consistency, and how old it may be.
PLAYBOOK = {
    "required_sections": ["title", "body"],
    "required_fields": ["source", "lang", "stamp"],
    "validity_rules": [
        {"type": "pattern_match", "field": "source", "pattern": "^src[0-9]+$"},
        {"type": "required", "field": "lang"},
        {"type": "pattern_match", "field": "text", "pattern": r"[.!?]\s*$"},
    ],
    "consistency_rules": [
        {"type": "range_check", "field": "n_chars", "min": 200, "max": 20000, "severity": "high"},
        {"type": "value_match", "field": "lang", "expected": "en", "severity": "low"},
        {"type": "range_check", "field": "_s", "min": 2, "max": 500, "severity": "critical"},
    ],
    "freshness_sla_hours": 87600.0,
}
AS_OF = "2024-06-30"
_CS = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[.!?]+(\s+[A-Z0-9\"''(\[{]|$)', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '')".replace('\\"', '"')


def records(x: DataFrame, playbook: dict = PLAYBOOK) -> DataFrame:
    """Chunk records of texts with source, lang and n_chars: facts, a title (a short first line without a full stop), the first date, repeated lines and noise."""
    t = F.col("text")
    x = with_facts(x)
    first = T.stripped(F.substring_index(t, "\n", 1))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda v: F.lower(F.regexp_replace(T.stripped(v), r"\s+", " "))), lambda v: F.length(v) >= 3)
    x = x.withColumns({"title": F.when(F.contains(t, F.lit("\n")) & F.length(first).between(1, 80) & ~F.rlike(first, F.lit("[.!?]$")), first), "stamp": F.regexp_extract(t, r"\b(\d{4}-\d{2}-\d{2})\b", 1), "_a": lines})
    x = x.withColumn("_rep", F.when(F.size("_a") == 0, 0.0).otherwise((F.size("_a") - F.size(F.array_distinct("_a"))) / F.greatest(F.size("_a"), F.lit(1)))).drop("_a")
    return x.withColumns({"_noise": T.noise_score(t, F.col("_rep")), "_few": S.letters_share(t) < 0.5})


def scores(playbook: dict = PLAYBOOK, as_of: str = AS_OF) -> dict:
    """All twelve scores of `records`, each from the record itself. Of a text that is one chunk the lines stand for chunks in uniqueness. Texts under half letters are
    scored as the simpler scorer does: their spelling by the share of ASCII, their timeliness as unknown."""
    t, none, few = F.col("text"), F.lit(None).cast("string"), F.col("_few")
    has = lambda **c: F.array_compact(F.array(*[F.when(v, k) for k, v in c.items()]))
    full = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return {
        "completeness": S.playbook_completeness(has(title=F.col("title").isNotNull(), body=F.col("_w") > 50), has(source=full("source"), lang=full("lang"), stamp=full("stamp")), playbook["required_sections"], playbook["required_fields"]),
        "validity": S.rules_passed(playbook["validity_rules"]), "consistency": S.rules_consistent(playbook["consistency_rules"]), "uniqueness": 1 - F.col("_rep"),
        "timeliness": F.when(few, 0.5).otherwise(S.timeliness(F.col("stamp"), F.lit(as_of), playbook["freshness_sla_hours"])), "text_integrity": S.integrity(F.col("_rep"), F.col("_noise"), F.when(few, S.ascii_share(t)).otherwise(0.85)), "parse_success": S.parse_success(t, n=F.col("_n")),
        "chunk_boundary_quality": F.when(T.ends_mid_sentence(t), 0.0).otherwise(1.0), "chunk_coherence": S.rounded(S.connectivity(t)), "chunk_size_health": S.rounded(S.size_health(F.col("token_est"))),
        "metadata_completeness": S.present(F.col("source"), F.col("title"), F.col("lang"), F.col("stamp")), "provenance_coverage": S.provenance(F.when(t != "", F.md5(t)), F.col("source"), none, none, F.col("stamp"), none),
    }


_REC = rf"""SELECT *, length(regexp_replace(text, '\P{{L}}', '', 'g'))::DOUBLE / greatest(length(text), 1) < 0.5 AS few, CASE WHEN length(text) < 10 THEN 1.0::DOUBLE ELSE greatest(0.0, least(1.0, 1 - (0.6 * least(1.0, rep * 2) + 0.4 * least(1.0, 5 * {_ODD})))) END AS noise FROM (
  SELECT *, CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE (len(a) - len(list_distinct(a)))::DOUBLE / len(a) END AS rep, CASE WHEN contains(text, chr(10)) AND length(l1) BETWEEN 1 AND 80 AND NOT regexp_matches(l1, '[.!?]$') THEN l1 END AS title, coalesce(source <> '', FALSE)::INT AS has_source, coalesce(lang <> '', FALSE)::INT AS has_lang, (stamp <> '')::INT AS has_stamp FROM (
    SELECT doc_id, text, lang, source, n_chars, {NW} AS w, {_TS} AS n, {_SENT} AS s, {_LINES} AS a, {STRIP.format("split_part(text, chr(10), 1)")} AS l1, {STRIP.format('text')} AS st,
      regexp_extract(text, '\b(\d{{4}}-\d{{2}}-\d{{2}})\b', 1) AS stamp, list_transform({_CS}, lambda x: list_distinct(regexp_extract_all(lower(x), '[^\x20\x09-\x0D]+'))) AS c
    FROM (SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars FROM documents)))"""
_SLA = PLAYBOOK["freshness_sla_hours"]
#: The twelve scores in SQL, over _REC.
_SCORES = {
    "completeness": "(((title IS NOT NULL)::INT + (w > 50)::INT) / 2.0::DOUBLE * 0.6::DOUBLE + (has_source + has_lang + has_stamp) / 3.0::DOUBLE * 0.4::DOUBLE)",
    "validity": r"(regexp_matches(coalesce(source, ''), '(?i)^src[0-9]+$')::INT + has_lang + regexp_matches(text, '(?i)[.!?]\s*$')::INT) / 3.0::DOUBLE",
    "consistency": "(CASE WHEN coalesce(n_chars BETWEEN 200 AND 20000, FALSE) THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN coalesce(lang = 'en', FALSE) THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN s BETWEEN 2 AND 500 THEN 1 ELSE 0 END) / 2.0::DOUBLE",
    "uniqueness": "1 - rep",
    "timeliness": f"CASE WHEN few OR try_cast(stamp AS DATE) IS NULL OR try_cast(stamp AS DATE) > DATE '{AS_OF}' THEN 0.5::DOUBLE ELSE greatest(0.0, least(1.0, 1 - datediff('day', try_cast(stamp AS DATE), DATE '{AS_OF}') * 24.0::DOUBLE / {_SLA}::DOUBLE)) END",
    "text_integrity": "greatest(0.0, least(1.0, noise * (1 - rep * 0.5::DOUBLE))) * 0.6::DOUBLE + CASE WHEN few THEN CASE WHEN length(text) = 0 THEN 1.0::DOUBLE ELSE length(regexp_replace(substr(text, 1, 1000), '[^\\x00-\\x7F]', '', 'g'))::DOUBLE / length(substr(text, 1, 1000)) END ELSE 0.85::DOUBLE END * 0.4::DOUBLE",
    "parse_success": "CASE WHEN n >= 50 THEN 1.0::DOUBLE ELSE 0.0 END",
    "chunk_boundary_quality": r"CASE WHEN NOT regexp_matches(st, '[.!?][''\")\]]*$') AND (NOT regexp_matches(st, '[0-9A-Za-z_]$') OR length(st) < 20) THEN 0.0::DOUBLE ELSE 1.0 END".replace('\\"', '"'),
    "chunk_coherence": "round((CASE WHEN n < 50 THEN 0.0 WHEN len(c) < 2 THEN 1.0 ELSE list_avg(list_transform(range(2, len(c) + 1), lambda i: len(list_intersect(c[i - 1], c[i]))::DOUBLE / len(list_distinct(list_concat(c[i - 1], c[i]))))) END)::DOUBLE + 1e-9, 4)",
    "chunk_size_health": f"round(({_size_sql('floor(w * 1.3)', *S.SIZES['general'])})::DOUBLE + 1e-9, 4)",
    "metadata_completeness": "(has_source + (title IS NOT NULL)::INT + has_lang + has_stamp) / 4.0::DOUBLE",
    "provenance_coverage": "CASE WHEN text <> '' THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN has_source = 1 THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN has_stamp = 1 THEN 0.15::DOUBLE ELSE 0 END",
}
_TRUST_SUM = " + ".join(f"{k} * {v}::DOUBLE" for k, v in S.WEIGHTS.items())
_SCORED = f"SELECT *, round({_TRUST_SUM} + 1e-9, 4) AS ai_trust FROM (SELECT doc_id, lang, source, text, floor(w * 1.3) AS tok, w, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in _SCORES.items())} FROM ({_REC}))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their twelve scores and the trust score."""
    x = records(dealt_docs(spark, sf_dir)).select("doc_id", "lang", "source", "text", F.col("token_est").alias("tok"), F.col("_w").alias("w"), *[c.cast("double").alias(k) for k, c in scores().items()])
    return x.withColumn("ai_trust", S.trust({k: F.col(k) for k in S.WEIGHTS}))


@query(f"SELECT doc_id, {', '.join(f'round({k} + 1e-9, 4) AS {k}' for k in S.WEIGHTS)}, ai_trust FROM ({_SCORED})")
def trust_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve scores of each document and their weighted sum."""
    return scored(spark, sf_dir).select("doc_id", *[S.rounded(F.col(k)).alias(k) for k in S.WEIGHTS], "ai_trust")


_FP = f"""SELECT *, round({_TRUST_SUM} + 1e-9, 4) AS ai_trust FROM (SELECT {{key}} AS {{key}}, count(*) AS num_chunks, sum(tok)::BIGINT AS total_tokens, min(tok)::INTEGER AS min_tokens, max(tok)::INTEGER AS max_tokens, round(sum(tok)::DOUBLE / count(*), 2) AS avg_tokens,
  list_sort(list(tok::INTEGER))[least((floor(0.95 * count(*)) + 1)::INT, count(*)::INT)] AS p95_tokens, {', '.join(f'round(avg({k}) + 1e-9, 4) AS {k}' for k in S.WEIGHTS)},
  round(avg(CASE WHEN {_PII} THEN 0.0 ELSE 1.0 END) + 1e-9, 4) AS secure, round(avg(CASE WHEN w > 50 AND contains(text, chr(10)) THEN 1.0 ELSE 0.5 END) + 1e-9, 4) AS kb_ready FROM ({_SCORED}) GROUP BY {{key}})"""


def fingerprint(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """Means of the scores by group, token totals, and trust from the means; the 95 % point is found in a histogram of token counts, so no group's tokens are gathered."""
    t = F.col("text")
    sums = (*S.WEIGHTS, "secure", "kb_ready")
    x = scored(spark, sf_dir).select(key, "tok", *S.WEIGHTS, S.secure(t).alias("secure"), S.kb_ready(t, F.col("w")).alias("kb_ready"))
    counts = x.groupBy(key, "tok").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    w = Window.partitionBy(key).orderBy("tok")
    total = F.sum("n").over(Window.partitionBy(key))
    place = F.least(F.floor(total * 0.95) + 1, total)
    counts = counts.withColumn("p", F.when((F.sum("n").over(w) >= place) & (F.sum("n").over(w) - F.col("n") < place), F.col("tok")))
    mean = lambda c: S.rounded(F.sum(c) / F.sum("n"))
    g = counts.groupBy(key).agg(
        F.sum("n").alias("num_chunks"), F.sum(F.col("tok") * F.col("n")).cast("bigint").alias("total_tokens"), F.min("tok").alias("min_tokens"), F.max("tok").alias("max_tokens"), F.max("p").alias("p95_tokens"), *[mean(c).alias(c) for c in sums]
    )
    return g.withColumn("avg_tokens", F.round(F.col("total_tokens") / F.col("num_chunks"), 2)).withColumn("ai_trust", S.trust({k: F.col(k) for k in S.WEIGHTS}))


_POLICY = """, CASE WHEN ai_trust < 0.5 OR secure < 0.9 THEN 'failed' WHEN metadata_completeness < 0.8 OR kb_ready < 0.5 THEN 'warnings' ELSE 'passed' END AS status,
  list_filter([CASE WHEN ai_trust < 0.5 THEN 'low_trust(<0.5)' END, CASE WHEN secure < 0.9 THEN 'security_not_full(<0.9)' END, CASE WHEN metadata_completeness < 0.8 THEN 'weak_metadata(<0.8)' END, CASE WHEN kb_ready < 0.5 THEN 'kb_not_ready(<0.5)' END], lambda x: x IS NOT NULL) AS violations"""
#: Fixed default limits of the policy.
LIMITS = (("ai_trust", 0.5, "low_trust"), ("secure", 0.9, "security_not_full"), ("metadata_completeness", 0.8, "weak_metadata"), ("kb_ready", 0.5, "kb_not_ready"))


def with_policy(fp: DataFrame, limits=LIMITS) -> DataFrame:  # noqa: ANN001
    """status and violations of each fingerprint: the first two limits are critical."""
    said = [F.when(F.col(c) < v, f"{name}(<{v})") for c, v, name in limits]
    critical = said[0].isNotNull() | said[1].isNotNull()
    x = fp.withColumn("violations", F.array_compact(F.array(*said)))
    return x.withColumn("status", F.when(critical, "failed").when(F.size("violations") > 0, "warnings").otherwise("passed"))


@query(f"SELECT * {_POLICY} FROM ({_FP.replace('{key}', 'lang')})")
def readiness_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readiness fingerprint of each language and its policy status."""
    return with_policy(fingerprint(spark, sf_dir, "lang"))


@query(f"SELECT * {_POLICY} FROM ({_FP.replace('{key}', 'source')})")
def readiness_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readiness fingerprint of each source, as of each file of a product, and its policy status."""
    return with_policy(fingerprint(spark, sf_dir, "source"))


_LOWQ = rf"(length(text) < 50 OR ({NW} > 10 AND (SELECT max(n) FROM (SELECT count(*) AS n FROM unnest({W}) AS u(w) GROUP BY w)) > {NW} * 0.3) OR length(regexp_replace(text, '\P{{L}}', '', 'g')) < length(text) * 0.5)"


@query(
    f"""WITH m AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT source) AS docs, avg(length(text)) AS mean, min(length(text)) AS least, max(length(text)) AS most, count_if(length(text) < 50)::BIGINT AS empty,
    (SELECT count(*) - count(DISTINCT text) FROM documents) AS dup, count_if(contains(text, chr(0)))::BIGINT AS enc, count_if({_LOWQ})::BIGINT AS low FROM documents),
s AS (SELECT *, 10 - CASE WHEN empty > 0 THEN least(3.0, empty / n * 10) ELSE 0 END - CASE WHEN dup > 0 THEN least(2.0, dup / n * 10) ELSE 0 END - CASE WHEN enc > 0 THEN least(2.5, enc / n * 10) ELSE 0 END - CASE WHEN low > 0 THEN least(1.5, low / n * 10) ELSE 0 END AS dq,
  10 - CASE WHEN mean < 200 THEN 2.0 WHEN mean > 1500 THEN 1.5 ELSE 0 END - CASE WHEN least < 50 THEN 2.5 ELSE 0 END - CASE WHEN most > 3000 THEN 2.0 ELSE 0 END AS cq,
  10 - CASE WHEN docs < 5 THEN 3.0 WHEN docs < 20 THEN 1.5 ELSE 0 END - CASE WHEN n < 100 THEN 2.5 ELSE 0 END AS cov FROM m)
SELECT n::BIGINT AS chunks, docs AS documents, round(mean, 4) AS avg_size, empty AS empty_chunks, dup AS duplicates, enc AS encoding_issues, low AS low_quality, round(dq::DOUBLE, 1) AS data_quality, round(cq::DOUBLE, 1) AS chunk_quality, round(cov::DOUBLE, 1) AS coverage,
  round((dq * 0.3 + cq * 0.3 + 8.5 * 0.2 + cov * 0.2)::DOUBLE, 1) AS overall,
  round((35 * round(cov::DOUBLE, 1) / 10 + 35 * 0.85 + 30 * round(cq::DOUBLE, 1) / 10)::DOUBLE, 1) AS rag, round((45 * round(dq::DOUBLE, 1) / 10 + 35 * round(cq::DOUBLE, 1) / 10 + 20 * round(cov::DOUBLE, 1) / 10)::DOUBLE, 1) AS fine_tuning,
  round((40 * round(dq::DOUBLE, 1) / 10 + 30 * round(cov::DOUBLE, 1) / 10 + 30 * round(cq::DOUBLE, 1) / 10)::DOUBLE, 1) AS classification, round((40 * round(dq::DOUBLE, 1) / 10 + 35 * round(cov::DOUBLE, 1) / 10 + 25 * round(cq::DOUBLE, 1) / 10)::DOUBLE, 1) AS agentic,
  round((50 * round(cov::DOUBLE, 1) / 10 + 35 * round(cq::DOUBLE, 1) / 10 + 15 * round(dq::DOUBLE, 1) / 10)::DOUBLE, 1) AS summarization FROM s"""
)
def corpus_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of a corpus, its readiness scores of 0 to 10, and how well it suits five uses, in one pass and one aggregate of distinct texts."""
    t, n = F.col("text"), F.length("text")
    d = docs(spark, sf_dir)
    one = d.select("source", n.alias("len"), F.xxhash64(t).alias("h"), F.md5(t).alias("m"), F.contains(t, F.lit("\0")).alias("enc"), T.low_quality(t).alias("low"))
    part = one.groupBy("source", "h", "m").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("s"), F.min("len").alias("lo"), F.max("len").alias("hi"), F.count_if(F.col("len") < 50).alias("e"), F.count_if("enc").alias("enc"), F.count_if("low").alias("low"))
    texts = part.groupBy("h", "m").agg(*[F.sum(c).alias(c) for c in ("n", "s", "e", "enc", "low")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    a = texts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.sum(c).alias(c) for c in ("e", "enc", "low")])
    sources = d.select("source").filter("source IS NOT NULL").distinct().agg(F.count(F.lit(1)).alias("docs"))
    a = a.join(sources, F.lit(True)).withColumn("dup", F.col("n") - F.col("u")).withColumn("mean", F.col("s") / F.col("n"))
    lose = lambda c, most: F.least(F.lit(most), F.col(c) / F.col("n") * 10)
    dq = 10 - lose("e", 3.0) - lose("dup", 2.0) - lose("enc", 2.5) - lose("low", 1.5)
    cq = 10 - F.when(F.col("mean") < 200, 2.0).when(F.col("mean") > 1500, 1.5).otherwise(0.0) - F.when(F.col("lo") < 50, 2.5).otherwise(0.0) - F.when(F.col("hi") > 3000, 2.0).otherwise(0.0)
    cov = 10 - F.when(F.col("docs") < 5, 3.0).when(F.col("docs") < 20, 1.5).otherwise(0.0) - F.when(F.col("n") < 100, 2.5).otherwise(0.0)
    a = a.select("*", dq.alias("dq"), cq.alias("cq"), cov.alias("cov"))
    r = {k: F.round(k, 1) / 10 for k in ("dq", "cq", "cov")}
    use = lambda **w: F.round(sum((r[k] * v for k, v in w.items() if k in r), F.lit(w.get("eq", 0) * 0.85)), 1)
    return a.select(
        F.col("n").alias("chunks"), F.col("docs").alias("documents"), F.round("mean", 4).alias("avg_size"), F.col("e").alias("empty_chunks"), F.col("dup").alias("duplicates"), F.col("enc").alias("encoding_issues"), F.col("low").alias("low_quality"),
        F.round("dq", 1).alias("data_quality"), F.round("cq", 1).alias("chunk_quality"), F.round("cov", 1).alias("coverage"), F.round(F.col("dq") * 0.3 + F.col("cq") * 0.3 + 8.5 * 0.2 + F.col("cov") * 0.2, 1).alias("overall"),
        use(cov=35, eq=35, cq=30).alias("rag"), use(dq=45, cq=35, cov=20).alias("fine_tuning"), use(dq=40, cov=30, cq=30).alias("classification"), use(dq=40, cov=35, cq=25).alias("agentic"), use(cov=50, cq=35, dq=15).alias("summarization"),
    )




@query(
    rf"""WITH s AS (SELECT doc_id, text, list_transform({_CS}, lambda x: list_distinct(regexp_extract_all(lower(x), '[^\x20\x09-\x0D]+'))) AS a FROM documents)
SELECT doc_id, round((CASE WHEN {_TS} < 50 THEN 0.0 WHEN len(a) < 2 THEN 1.0 ELSE list_avg(list_transform(range(2, len(a) + 1), lambda i: len(list_intersect(a[i - 1], a[i]))::DOUBLE / len(list_distinct(list_concat(a[i - 1], a[i]))))) END)::DOUBLE, 6) AS coherence, len(a)::INTEGER AS sentences FROM s"""
)
def sentence_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of neighbouring sentences."""
    t = F.col("text")
    cut = F.filter(F.transform(F.split(t, r"[.!?]+(?=\s+[A-Z0-9\"'(\[{]|$)"), T.stripped), lambda s: s != "")
    return docs(spark, sf_dir).select("doc_id", F.round(S.connectivity(t), 6).alias("coherence"), F.size(cut).alias("sentences"))


_NOISE = " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}'), lambda m: length(m))), 0)" for ps in S.NOISE.values() for p in ps)


@query(f"SELECT page_id, round(1 - least(1.0, ({_NOISE}) / greatest(length(text), 1))::DOUBLE, 6) AS noise_free FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '\\n+', chr(10), 'g') AS text FROM pages)")
def page_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a page's text outside boilerplate, navigation and legal footers."""
    x = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("html", "<[^>]*>", "\n"), r"\n+", "\n").alias("text"))
    return x.select("page_id", F.round(S.noise_free(F.col("text")), 6).alias("noise_free"))


@query(
    rf"""SELECT doc_id, letters < 0.5 AS fallback_used, round(letters, 6) AS letters, round(ascii, 6) AS ascii FROM (SELECT doc_id, length(regexp_replace(text, '\P{{L}}', '', 'g'))::DOUBLE / greatest(length(text), 1) AS letters,
  CASE WHEN length(text) = 0 THEN 1.0 ELSE length(regexp_replace(substr(text, 1, 1000), '[^\x00-\x7F]', '', 'g'))::DOUBLE / length(substr(text, 1, 1000)) END AS ascii FROM documents)"""
)
def scorer_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under half letters, which the simpler scorer takes; its integrity reads the first 1,000 characters by definition."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", (S.letters_share(t) < 0.5).alias("fallback_used"), F.round(S.letters_share(t), 6).alias("letters"), F.round(S.ascii_share(t), 6).alias("ascii"))


#: The sentence cut without looking behind and ahead: ends before a space and a capital, digit or quote are marked, those behind a single capital are taken back, and the rest is cut.
_ENDS = "[.!?۔؟。]"
_CUTS = rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(t, '({_ENDS}+)(\s+[A-Z0-9\"''])', '\1' || chr(1) || '\2', 'g'), '(^|[^\p{{L}}\p{{N}}_])([A-Z])({_ENDS})' || chr(1), '\1\2\3', 'g'), '{_ENDS}+' || chr(1)), lambda x: {STRIP.format('x')}), lambda x: x <> '')".replace('\\"', '"')


@query(
    rf"""WITH x AS (SELECT doc_id, lang, lower(trim(coalesce(source, ''))) AS sec, source, {STRIP.format('text')} AS t FROM documents),
y AS (SELECT *, {_CUTS} AS cut, regexp_extract_all(lower(t), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+') AS dw FROM x),
z AS (SELECT *, CASE WHEN len(cut) = 0 THEN len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::DOUBLE ELSE list_sum(list_transform(cut, lambda s: len(regexp_extract_all(s, '[^\x20\x09-\x0D]+'))))::DOUBLE / len(cut) END AS mean FROM y),
q AS (SELECT *, CASE WHEN mean <= 0 THEN 0.0::DOUBLE WHEN mean < 10 THEN mean / 10 WHEN mean > 30 THEN greatest(0.0, 1 - (mean - 30) / 30) ELSE 1.0 END AS q, CASE WHEN sec <> '' AND contains(lower(t), sec) THEN 1.0::DOUBLE ELSE 0.5 END AS ctx, CASE WHEN coalesce(source, '') <> '' THEN 1.0::DOUBLE ELSE 0.5 END AS meta FROM z)
SELECT doc_id, round(CASE WHEN length(t) = 0 THEN 1.0::DOUBLE ELSE length(regexp_replace(substr(t, 1, 1000), '[^\x00-\x7F]', '', 'g'))::DOUBLE / length(substr(t, 1, 1000)) END, 6) AS text_integrity, 0.5::DOUBLE AS timeliness, CASE WHEN length(t) >= 50 THEN 1.0::DOUBLE ELSE 0.0 END AS parse_success,
  CASE WHEN regexp_matches(t, '{T.EMAIL}') OR regexp_matches(t, '{T.PHONE}') THEN 0.75::DOUBLE ELSE 1.0 END AS "Secure", round(q, 6) AS "Quality", ctx AS "Context_Quality", meta AS "Metadata_Presence",
  CASE WHEN lower(coalesce(lang, 'unknown')) IN ('', 'unknown') THEN 0.25::DOUBLE ELSE 1.0 END AS "Audience_Intentionality", round(CASE WHEN len(dw) = 0 THEN 0.0::DOUBLE ELSE len(list_distinct(dw))::DOUBLE / len(dw) END, 6) AS "Diversity",
  round(CASE WHEN mean BETWEEN 10 AND 25 THEN 1.0::DOUBLE WHEN mean > 0 THEN greatest(0.0, 1 - least(abs(mean - 17.5) / 25, 1.0)) ELSE 0.0 END, 6) AS "Audience_Accessibility", round(greatest(0.0, least(1.0, meta * 0.4::DOUBLE + q * 0.4::DOUBLE + ctx * 0.2::DOUBLE)), 6) AS "KnowledgeBase_Ready",
  floor(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) * 1.3)::DOUBLE AS token_est FROM q"""
)
def fallback_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simpler scorer's metrics of every document."""
    m = S.fallback(F.col("text"), F.col("source"), F.lit("body"), F.col("doc_id"), F.col("lang"))
    return dealt_docs(spark, sf_dir).select("doc_id", *[F.round(c, 6).alias(k) for k, c in m.items()])


@query(
    f"""SELECT category, count(*) AS docs, round(avg(secure), 6) AS secure, round(avg(kb), 6) AS kb_ready, round(avg(t) + 1e-9, 4) AS trust FROM (SELECT CASE WHEN t >= 0.7 THEN 'AI-Ready' ELSE 'Non-AI Ready' END AS category, * FROM
  (SELECT ai_trust AS t, (CASE WHEN {_PII} THEN 0.0 ELSE 1.0 END)::DOUBLE AS secure, (CASE WHEN w > 50 AND contains(text, chr(10)) THEN 1.0 ELSE 0.5 END)::DOUBLE AS kb FROM ({_SCORED}))) GROUP BY category"""
)
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics of documents at or above a trust of 0.7, and of the others."""
    t = F.col("text")
    x = scored(spark, sf_dir).select(F.col("ai_trust").alias("t"), S.secure(t).alias("secure"), S.kb_ready(t, F.col("w")).alias("kb"))
    g = x.groupBy(F.when(F.col("t") >= 0.7, "AI-Ready").otherwise("Non-AI Ready").alias("category"))
    return g.agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("secure"), 6).alias("secure"), F.round(F.avg("kb"), 6).alias("kb_ready"), S.rounded(F.avg("t")).alias("trust"))
