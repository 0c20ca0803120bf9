"""Queries over duplicates, pages, sections and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import dedup as D
from ..session import table
from .registry import query
from .text_queries import NW, STRIP, dealt_docs, docs


@query("SELECT count(*)::BIGINT AS total, count(DISTINCT text)::BIGINT AS distinct_texts, round(1 - count(DISTINCT text)::DOUBLE / count(*), 6) AS duplicate_rate FROM documents")
def exact_duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents repeat another one exactly."""
    return D.exact_duplicates(docs(spark, sf_dir))


_LINES = f"""WITH l AS (SELECT doc_id, {STRIP.format('line')} AS norm, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
g AS (SELECT doc_id, norm, count(*) AS n FROM l WHERE norm <> '' GROUP BY ALL HAVING count(*) >= 3)"""


@query(
    _LINES + r""" SELECT doc_id, count(*) AS repeated_lines, sum(n - 1)::BIGINT AS removed_lines, bool_or(contains(lower(norm), 'page') AND regexp_matches(norm, '\d')) AS page_numbers, bool_or(length(norm) < 100) AS headers,
  bool_or(regexp_matches(lower(norm), 'copyright|confidential|proprietary|all rights reserved')) AS footers, bool_or(regexp_matches(norm, '(?i)^\s*\d+\.\s+|^\s*[A-Z][a-z]+\s+\.{3,}|^\s*Chapter\s+\d+')) AS nav FROM g GROUP BY doc_id"""
)
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that occur three times or more in a document, and what they look like."""
    return D.boilerplate(docs(spark, sf_dir), "doc_id")


@query(
    f"""WITH l AS (SELECT doc_id, line, pos, {STRIP.format('line')} AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, norm) AS n, min(pos) OVER (PARTITION BY doc_id, norm) AS first FROM l)
SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (norm = '' OR n < 3 OR pos = first), '')) AS text_md5 FROM k GROUP BY doc_id"""
)
def boilerplate_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with repeated lines kept once."""
    return D.without_boilerplate(docs(spark, sf_dir), "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS i, len(a) AS m, a FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS a FROM documents)),
g AS (SELECT doc_id, word, i, i + 3 <= m AS whole, CASE WHEN i + 3 <= m THEN array_to_string(a[i:i + 3], ' ') END AS gram FROM w),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, gram, whole) AS n, min(i) OVER (PARTITION BY doc_id, gram, whole) AS first FROM g)
SELECT doc_id, md5(string_agg(word, ' ' ORDER BY i)) AS text_md5, count(*) AS words FROM c WHERE NOT whole OR n < 3 OR i = first GROUP BY doc_id"""
)
def repeated_ngrams_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the words that start a four-word sequence seen before, if it occurs three times."""
    x = D.without_repeated_ngrams(dealt_docs(spark, sf_dir), "doc_id")
    return x.select("doc_id", F.md5("text").alias("text_md5"), F.size(F.split("text", " ")).cast("bigint").alias("words"))


@query(
    f"""WITH l AS (SELECT doc_id, {STRIP.format('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)), g AS (SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL),
r AS (SELECT doc_id, sum(n) AS total, sum(CASE WHEN n >= 3 THEN n - 1 ELSE 0 END) AS again FROM g GROUP BY doc_id)
SELECT d.doc_id, round(CASE WHEN coalesce(total, 0) < 3 THEN 0.0 ELSE least(1.0, again::DOUBLE / total) END, 6) AS repetition FROM documents d LEFT JOIN r USING (doc_id)"""
)
def line_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a document's lines that repeat one that occurs three times or more."""
    return docs(spark, sf_dir).select("doc_id", F.round(D.line_repetition(F.col("text")), 6).alias("repetition"))


@query(
    r"""WITH s AS (SELECT conv_id, turn, lower(array_to_string(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), ' ')) AS t, text FROM conversations),
g AS (SELECT DISTINCT conv_id, turn, substr(t, i, 5) AS g FROM s, unnest(range(1, length(t) - 3)) AS u(i)), z AS (SELECT conv_id, turn, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT a.conv_id, a.turn AS i, b.turn AS j, count(*) AS c FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.g = b.g AND a.turn < b.turn GROUP BY ALL),
o AS (SELECT p.conv_id, sum(c::DOUBLE / (x.n + y.n - c)) AS t FROM p JOIN z x ON p.conv_id = x.conv_id AND p.i = x.turn JOIN z y ON p.conv_id = y.conv_id AND p.j = y.turn GROUP BY p.conv_id),
l AS (SELECT conv_id, turn, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations)),
lg AS (SELECT conv_id, turn, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL),
lr AS (SELECT conv_id, turn, CASE WHEN sum(n) < 3 THEN 0.0 ELSE least(1.0, sum(CASE WHEN n >= 3 THEN n - 1 ELSE 0 END)::DOUBLE / sum(n)) END AS r FROM lg GROUP BY ALL),
e AS (SELECT s.conv_id, count(*) AS n_chunks, count(z.n) AS k, avg(coalesce(r, 0.0)) AS r FROM s LEFT JOIN z USING (conv_id, turn) LEFT JOIN lr USING (conv_id, turn) GROUP BY s.conv_id),
f AS (SELECT conv_id, n_chunks, (k * (k - 1)) // 2 AS pairs, CASE WHEN k * (k - 1) > 0 THEN coalesce(t, 0.0) / ((k * (k - 1)) // 2) ELSE 0.0 END AS overlap, r FROM e LEFT JOIN o USING (conv_id))
SELECT conv_id, n_chunks, pairs, round(overlap, 6) AS overlap, round(r, 6) AS repetition, CASE WHEN n_chunks < 2 THEN 100.0 ELSE round(greatest(0.0, (1 - (overlap * 0.7 + r * 0.3)) * 100), 2) END::DOUBLE AS score FROM f"""
)
def conversation_duplicate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the turns of a conversation, as chunks of a document, repeat each other."""
    x = table(spark, sf_dir, "conversations").withColumn("text", T.text_of("text"))
    return D.duplicate_score(x, "conv_id", "turn")


_FENCED = "WITH f AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^[a-z](.*)$', '=== PAGE 7 ===' || chr(10) || '\\1', 'g'), chr(10)) AS a FROM documents)"


@query(
    _FENCED + r""", l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM f), m AS (SELECT *, regexp_matches(line, '^=== PAGE (\d+) ===$') AS fence FROM l),
p AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM m),
q AS (SELECT *, coalesce(last_value(CASE WHEN fence THEN regexp_extract(line, '^=== PAGE (\d+) ===$', 1)::INT END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n), 1) AS page FROM p)
SELECT doc_id, part::BIGINT AS part_no, page, md5(regexp_replace(string_agg(line, chr(10) ORDER BY n), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS text_md5 FROM q WHERE NOT fence GROUP BY doc_id, part, page"""
)
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at page fences, which are put before lines that start in lower case."""
    fenced = F.regexp_replace("text", r"(?m)^[a-z](.*)$", "=== PAGE 7 ===\n$1")
    lines = C.pages(docs(spark, sf_dir).withColumn("text", fenced), "doc_id", with_part=True)
    return lines.select("doc_id", F.col("part").alias("part_no"), "page", F.md5("text").alias("text_md5"))


@query(
    rf"""WITH l AS (SELECT doc_id, {STRIP.format('line')} AS line, n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^The .*eriner thanea.$') THEN 1.0 WHEN regexp_matches(line, '^\d+[.\)]\s+.+$') OR regexp_matches(line, '^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+$') OR (regexp_matches(line, '^[A-Z0-9][A-Z0-9 &''\-]{{6,}}$') AND contains(line, ' ')) THEN 0.8 END AS conf FROM l WHERE line <> ''),
s AS (SELECT *, sum((conf IS NOT NULL)::INT) OVER w AS ord, coalesce(last_value(CASE WHEN conf IS NOT NULL THEN line END IGNORE NULLS) OVER w, 'Introduction') AS title, coalesce(last_value(conf IGNORE NULLS) OVER w, 0.5) AS confidence FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
b AS (SELECT doc_id, ord, title, confidence, string_agg(line, chr(10) ORDER BY n) AS body FROM s WHERE conf IS NULL GROUP BY ALL),
e AS (SELECT doc_id, ord::BIGINT AS ord, title, confidence::DOUBLE AS confidence, body FROM b UNION ALL SELECT doc_id, 0, 'Introduction', 0.0, {STRIP.format('text')} FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b))
SELECT doc_id, ord, title, substr(regexp_replace(regexp_replace(lower(title), '\s+', ' ', 'g'), '[^a-z0-9]+', '_', 'g'), 1, 40) AS section, confidence, md5(body) AS body_md5 FROM e"""
)
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at headings, by a pattern and by shape."""
    return C.sections(docs(spark, sf_dir), "doc_id", headers=("^The .*eriner thanea.$",)).select("doc_id", "ord", "title", "section", "confidence", F.md5("body").alias("body_md5"))


@query(
    f"""WITH c AS (SELECT doc_id, {STRIP.format('substr(text, s + 1, 800)')} AS chunk, s FROM documents, unnest(range(0, greatest(length(text) - 100, 1), 700)) AS u(s) WHERE length(text) > 0)
SELECT doc_id, count(*) AS chunks, round(avg(length(chunk)), 4) AS avg_size, min(length(chunk))::INTEGER AS min_size, max(length(chunk))::INTEGER AS max_size, round(var_pop(length(chunk)), 4) AS variance,
  CASE WHEN count(*) > 0 AND var_pop(length(chunk)) < 10000 THEN 'high' WHEN var_pop(length(chunk)) < 50000 THEN 'medium' ELSE 'low' END AS retrieval, md5(string_agg(chunk, '|' ORDER BY s)) AS chunks_md5
FROM c WHERE chunk <> '' GROUP BY doc_id"""
)
def char_chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 800 characters that overlap by 100, their sizes, and how even they are."""
    def figures(c):  # noqa: ANN001, ANN202
        n = F.size(c).cast("bigint")
        add = lambda f: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + f(F.length(x).cast("bigint")))
        total, squares = add(lambda v: v), add(lambda v: v * v)
        sizes = F.transform(c, lambda x: F.length(x))
        var = (n * squares - total * total) / (n * n)
        return F.struct(n.alias("chunks"), F.round(total / n, 4).alias("avg_size"), F.array_min(sizes).alias("min_size"), F.array_max(sizes).alias("max_size"), var.alias("v"), F.md5(F.array_join(c, "|")).alias("chunks_md5"))

    x = docs(spark, sf_dir).select("doc_id", T.let(C.char_chunks(F.col("text"), 200, 100), lambda c: F.when(F.size(c) > 0, figures(c))).alias("f")).filter("f IS NOT NULL").select("doc_id", "f.*")
    level = F.when(F.col("v") < 10000, "high").when(F.col("v") < 50000, "medium").otherwise("low")
    return x.select("doc_id", "chunks", "avg_size", "min_size", "max_size", F.round("v", 4).alias("variance"), level.alias("retrieval"), "chunks_md5")


def _chunk_query(strategy: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = C.records(C.chunk(docs(spark, sf_dir), "doc_id", strategy=strategy, max_tokens=200, overlap=100), "doc_id")
        return out.select("doc_id", "chunk_id", "chunk_index", "chunk_of", "token_est", "cleaned_text_hash")

    run.__name__ = f"{strategy}_chunks"
    run.__doc__ = f"Chunk records by the strategy {strategy}; greedy packing is beyond SQL and is tested against a plain model."
    return query()(run)


for _s in ("sentence", "paragraph_boundary", "fixed_size"):
    _chunk_query(_s)


@query(
    f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: {STRIP.format('x')}), lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) BETWEEN 5 AND 30)[1:3] AS a FROM documents)
SELECT doc_id, unnest(a) AS sentence, generate_subscripts(a, 1)::INTEGER AS n, 'What does the text say about ' || unnest(a) || '?' AS question FROM s"""
)
def synthetic_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from a document's first three sentences of 5 to 30 words."""
    s = F.filter(F.transform(F.split("text", r"\."), T.stripped), lambda x: T.n_words(x).between(5, 30))
    x = docs(spark, sf_dir).select("doc_id", F.posexplode(F.slice(s, 1, 3)).alias("i", "sentence"))
    return x.select("doc_id", "sentence", (F.col("i") + 1).alias("n"), F.concat(F.lit("What does the text say about "), "sentence", F.lit("?")).alias("question"))


@query(f"SELECT source, count(*) AS files, sum(tokens)::BIGINT AS tokens, sum(chunks)::BIGINT AS chunks, round(sum(tokens) / 1000.0 * 0.0003, 9)::DOUBLE AS cost FROM (SELECT source, floor({NW} * 1.3) AS tokens, greatest(1, ceil(floor({NW} * 1.3) / 800)) AS chunks FROM documents) GROUP BY source")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, chunks of 800 and embedding cost by source."""
    tok = T.token_estimate(F.col("text"))
    x = docs(spark, sf_dir).select("source", tok.alias("t")).select("source", "t", F.greatest(F.lit(1), F.ceil(F.col("t") / 800)).alias("c"))
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("t").cast("bigint").alias("tokens"), F.sum("c").cast("bigint").alias("chunks"), F.round(F.sum("t") / 1000.0 * 0.0003, 9).alias("cost"))
