"""Queries over texts: normalization, redaction, noise, and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import spread, table
from .registry import query

W = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
NW = f"len({W})"
STRIP = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
#: The edge of a word in any script, for an engine whose \b knows ASCII only.
L, R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("text", T.text_of("text"))


def dealt_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is long for each text, over all cores."""
    return spread(docs(spark, sf_dir), "doc_id", "text")


@query(
    f"""SELECT doc_id, length(text)::INTEGER AS n_chars_text, {NW}::INTEGER AS n_words, floor({NW} * 1.3)::INTEGER AS token_est,
  greatest(length(text) // 4, {NW})::INTEGER AS chunk_tokens,
  len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: {STRIP.format('x')}), lambda x: x <> ''))::INTEGER AS n_sentences
FROM documents"""
)
def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, words, both token estimates and sentences of each document."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.length(t).alias("n_chars_text"), T.n_words(t).alias("n_words"), T.token_estimate(t).alias("token_est"), T.chunk_tokens(t).alias("chunk_tokens"), F.size(T.sentences(t)).alias("n_sentences"))


_PII = " OR ".join(f"regexp_matches(text, '{p}')" for p in T.PII)
_REDACTED = f"regexp_replace(regexp_replace(regexp_replace(text, '{T.EMAIL}', '[redacted_email]', 'g'), '{T.PHONE}', '[redacted_phone]', 'g'), '{T.SSN}', '[SSN]', 'g')"


@query(f"SELECT doc_id, ({_PII}) AS has_pii, md5({_REDACTED}) AS redacted_md5, len(regexp_extract_all({_REDACTED}, '\\[redacted_email\\]'))::INTEGER AS emails, len(regexp_extract_all({_REDACTED}, '\\[redacted_phone\\]'))::INTEGER AS phones FROM documents")
def pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document holds personal data, and its text once that is masked."""
    out = docs(spark, sf_dir).select("doc_id", T.has_pii(F.col("text")).alias("has_pii"), T.redact(F.col("text")).alias("r"))
    return out.select("doc_id", "has_pii", F.md5("r").alias("redacted_md5"), F.regexp_count("r", F.lit(r"\[redacted_email\]")).alias("emails"), F.regexp_count("r", F.lit(r"\[redacted_phone\]")).alias("phones"))


@query(
    r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '(?m)^[ \t]+|[ \t]+$', '', 'g'), chr(10)) AS a FROM documents),
j AS (SELECT doc_id, array_to_string(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = 1 THEN '' WHEN regexp_matches(a[i], '^[a-z]') AND a[i - 1] <> '' AND NOT regexp_matches(a[i - 1], '[.!?]["'')\]]*$') THEN ' ' ELSE chr(10) END || a[i]), '') AS t FROM l)
SELECT doc_id, length(u)::INTEGER AS n, md5(u) AS unwrapped_md5 FROM (SELECT doc_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS u FROM j)"""
)
def line_unwrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with hyphenated and wrapped lines joined."""
    out = docs(spark, sf_dir).select("doc_id", T.unwrap_lines(F.col("text")).alias("u"))
    return out.select("doc_id", F.length("u").alias("n"), F.md5("u").alias("unwrapped_md5"))


_SPACED = "(length({0}) > 100 AND len(regexp_extract_all(substr({0}, 1, 500), ' ')) / length(substr({0}, 1, 500)) > 0.3)"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[ \t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"


def _repaired(c: str) -> str:
    for bad, good in [*T.LATIN_SIGNS, *T.MOJIBAKE]:
        c = f"replace({c}, '{bad}', '{good.replace(chr(39), chr(39) * 2)}')"
    return c


@query(f"SELECT doc_id, md5({_CLEAN.format('text')}) AS clean_md5, md5({_repaired('text')}) AS repaired_md5, {_SPACED.format('text')} AS spaced_out FROM documents")
def space_and_encoding_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space squeezed, and UTF-8 that was read as Latin-1 repaired."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(T.clean_spaces(t)).alias("clean_md5"), F.md5(T.repair_encoding(t)).alias("repaired_md5"), T.looks_spaced_out(t).alias("spaced_out"))


@query()
def full_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repairs, then corrections; back-references and look-behind are beyond the SQL engine's patterns."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalize(t)).alias("normal_md5"), F.md5(T.correct(t)).alias("correct_md5"), F.md5(T.collapse_doubled(t)).alias("single_md5"), F.md5(T.close_letters(t)).alias("closed_md5"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[|~]', ' ', 'g'), '(?i)(ein)', '<\1>', 'g'), '(?m)^(\S+)\.$', '\1', 'g')) AS step_md5 FROM documents""")
def playbook_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A playbook's own replacements, with a list pattern, flags and groups."""
    steps = [{"pattern": ["|", "~"], "replace": " "}, {"pattern": r"(ein)", "replace": r"<\1>", "flags": "IGNORECASE"}, {"pattern": r"^(\S+)\.$", "replace": r"\1", "flags": "MULTILINE"}, {"replace": "x"}]
    return docs(spark, sf_dir).select("doc_id", F.md5(T.apply_steps(F.col("text"), steps)).alias("step_md5"))


_ODD = r"length(regexp_replace(text, '[\p{L}\p{N}\s.,;:!?\-''\"()\[\]/\\@#%&*]', '', 'g')) / length(text)".replace('\\"', '"')
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(regexp_replace(trim(x, ' ' || chr(9) || chr(13)), '\\s+', ' ', 'g'))), lambda x: length(x) >= 3)"


@query(
    f"""WITH r AS (SELECT doc_id, text, {_LINES} AS a FROM documents), q AS (SELECT doc_id, text, CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE (len(a) - len(list_distinct(a)))::DOUBLE / len(a) END AS repetition FROM r)
SELECT doc_id, round(repetition, 6) AS repetition, round(CASE WHEN length(text) < 10 THEN 1.0::DOUBLE ELSE greatest(0.0, least(1.0, 1 - (0.6 * least(1.0, repetition * 2) + 0.4 * least(1.0, 5 * {_ODD})))) END, 6) AS noise, repetition >= 0.2 AS scanned FROM q"""
)
def line_repetition_and_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of repeated lines (any case and spacing, three characters or more), the noise score, and the mark of scanned text."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.lower(F.regexp_replace(T.stripped(x), r"\s+", " "))), lambda x: F.length(x) >= 3)
    x = docs(spark, sf_dir).select("doc_id", "text", lines.alias("a"))
    rep = F.when(F.size("a") == 0, 0.0).otherwise((F.size("a") - F.size(F.array_distinct("a"))) / F.greatest(F.size("a"), F.lit(1)))
    x = x.withColumn("rep", rep)
    return x.select("doc_id", F.round("rep", 6).alias("repetition"), F.round(T.noise_score(F.col("text"), F.col("rep")), 6).alias("noise"), (F.col("rep") >= 0.2).alias("scanned"))


_QUAL = rf"""CASE WHEN {STRIP.format('text')} = '' THEN 0.0::DOUBLE WHEN {_SPACED.format('text')} THEN 40.0 ELSE greatest(0.0, least(100.0, 80
  - len(regexp_extract_all(substr(text, 1, 500), ' ')) / length(substr(text, 1, 500)) * 100 - len(regexp_extract_all(text, '(?i){L}(?:teh|adn|hte|tha|taht){R}')) / greatest({NW}, 1) * 20
  - CASE WHEN length(text) < 50 THEN 10 ELSE 0 END - CASE WHEN regexp_matches(text, '\p{{Lu}}') THEN 0 ELSE 5 END - CASE WHEN regexp_matches(text, '[.!?]') THEN 0 ELSE 5 END)) END"""


@query(f"SELECT doc_id, round({_QUAL}, 6) AS quality FROM documents")
def quick_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quick quality of 0 to 100."""
    return docs(spark, sf_dir).select("doc_id", F.round(T.estimate_quality(F.col("text")), 6).alias("quality"))


_TOP = f"(SELECT max(n) FROM (SELECT count(*) AS n FROM unnest({W}) AS u(w) GROUP BY w))"
_LOW = rf"(length(text) < 50 OR ({NW} > 10 AND {_TOP} > {NW} * 0.3) OR length(regexp_replace(text, '\P{{L}}', '', 'g')) < length(text) * 0.5)"


@query(
    rf"""WITH x AS (SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g') AS text FROM documents), c AS (SELECT doc_id, length(text) AS n, substr(text, 1, 2000) AS text FROM x),
s AS (SELECT doc_id, n, text, {_LOW} AS low FROM c)
SELECT doc_id, low AS low_quality, CASE WHEN n >= 50 AND NOT low THEN md5(array_to_string({W}, ' ')) END AS controlled_md5 FROM s"""
)
def quality_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-quality texts, and what is left of the others once control characters and spaces are cleaned; 2,000 characters is the control's own limit."""
    cut = F.substring(F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F]", ""), 1, 2000)
    return docs(spark, sf_dir).select("doc_id", T.low_quality(cut).alias("low_quality"), F.md5(T.quality_controlled(F.col("text"))).alias("controlled_md5"))


@query(
    f"""SELECT doc_id, list_filter([CASE WHEN length(text) < 50 THEN 'Too short' END, CASE WHEN contains(text, chr(0)) THEN 'Encoding issues' END, CASE WHEN n < 10 THEN 'Too few words' END,
  CASE WHEN n > 10 AND top > n * 0.3 THEN 'Repetitive content' END], lambda x: x IS NOT NULL) AS issues FROM (SELECT doc_id, text, {NW} AS n, {_TOP} AS top FROM documents)"""
)
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of what is wrong with a text."""
    t = F.col("text")
    marks = ((F.length(t) < 50, "Too short"), (F.contains(t, F.lit("\0")), "Encoding issues"), (T.n_words(t) < 10, "Too few words"), ((T.n_words(t) > 10) & (T.top_share(t) > 0.3), "Repetitive content"))
    return docs(spark, sf_dir).select("doc_id", F.array_compact(F.array(*[F.when(c, name) for c, name in marks])).alias("issues"))


@query(
    f"""WITH s AS (SELECT doc_id, array_to_string({W}, ' ') AS t FROM documents), p AS (SELECT *, length(t) AS n, greatest(0, length(t) // 2 - 2500) AS m FROM s)
SELECT doc_id, n::INTEGER AS n, md5(CASE WHEN n <= 20000 THEN t ELSE substr(substr(t, 1, 5000) || ' === MIDDLE SAMPLE === ' || substr(t, m + 1, 5000) || ' === END SAMPLE === ' || substr(t, n - 4999), 1, 20000) END) AS sample_md5 FROM p"""
)
def representative_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, middle and tail of texts over 20,000 characters."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.length(T.squeezed(t)).alias("n"), F.md5(T.representative_sample(t)).alias("sample_md5"))


@query(
    rf"""SELECT doc_id, NOT regexp_matches(t, '[.!?][''")\]]*$') AND (NOT regexp_matches(t, '[0-9A-Za-z_]$') OR length(t) < 20) AS mid_sentence,
  CASE WHEN instr(t, '. ') BETWEEN 1 AND 300 THEN substr(t, 1, instr(t, '. ')) WHEN instr(t, '? ') BETWEEN 1 AND 300 THEN substr(t, 1, instr(t, '? ')) WHEN instr(t, '! ') BETWEEN 1 AND 300 THEN substr(t, 1, instr(t, '! ')) ELSE substr(t, 1, 250) END AS first_sentence,
  regexp_extract_all(text, '\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}})\b')[1:3] AS dates
FROM (SELECT doc_id, text, {STRIP.format('text')} AS t FROM documents)"""
)
def sentence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that end inside a sentence, their first sentences, and the first dates in them."""
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", T.ends_mid_sentence(t).alias("mid_sentence"), T.first_sentence(t).alias("first_sentence"), T.found_dates(t).alias("dates"))


@query(
    r"""WITH f AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'f.pdf' ELSE 'f.txt' END AS fn, regexp_replace(replace(replace(text, '=== PAGE', ''), '===', ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS a FROM documents)
SELECT kind, count(*) AS docs FROM (SELECT CASE WHEN fn <> 'f.pdf' OR text = '' THEN 'digital_pdf' WHEN length(a) < 500 OR length(a) / greatest(len(regexp_extract_all(text, '=== PAGE')), 1) < 50 THEN 'scanned_pdf' ELSE 'digital_pdf' END AS kind FROM f) GROUP BY kind"""
)
def extraction_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by how they were extracted; even ids stand for PDF files."""
    name = F.when(F.col("doc_id") % 2 == 0, "f.pdf").otherwise("f.txt")
    return docs(spark, sf_dir).groupBy(T.extraction_type(F.col("text"), name).alias("kind")).agg(F.count(F.lit(1)).alias("docs"))
