"""Document rules, and verdicts on hosts from their shrunken failure rates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, stratum, table, written

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def facts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text in UTF-8; ASCII white space alone separates words."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    repeated = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            often, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeated += i + 5 - max(end, i)
                    end = i + 5
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def document_facts(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text and with the five counts of facts(). A null text counts as ''. Works row by row, with no shuffle."""
    rest = [c for c in df.columns if c != text]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in rest if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [facts(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(len(kept)).cast(pa.binary())]
            cols = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)], [*kept, *names])

    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + [f"{c} bigint" for c in names])
    return arrow_map(df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string")), run, schema)


def host_rules(df: DataFrame, host: str = "source", text: str = "text", max_rate: float = 0.5, min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """Each row of df without its text, with its counts, base_failed, its host's rates and kept.

    A document fails if it has under min_words words or over max_repeat % of its words in repeated 5-word windows. Failures are
    summed by host (partial sums before the shuffle, so a hot host is one small row per task). Across hosts, a beta prior is fitted to the
    rates by moments: mean m of the hosts' rates and their variance v beyond what binomial noise gives leave
    s = m(1-m)/v - 1 and the prior (ms, (1-m)s), s held in [1, 10000]. A host's rate is (failures + ms) / (documents + s): hosts with few
    documents are drawn to the mean. Hosts with a rate above max_rate are rejected with all their documents.

    Nulls: a null text is empty and fails; a null host is a host of its own. Repeated rows count as often as they occur. An
    empty table gives an empty result. Columns of df named like a result column are replaced.
    """
    made = ["base_failed", "host_docs", "host_failures", "host_rate", "host_ok", "kept"]
    x = document_facts(df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made]), text)
    x = x.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))).withColumn("_q_h", stratum(host))
    x = written(x, "facts")  # narrow rows, so that the texts are read and counted once
    return join_verdicts(x, host_verdicts(x), max_rate)


def host_verdicts(x: DataFrame) -> DataFrame:
    """A row for each host: host_docs, host_failures, host_rate."""
    hosts = x.groupBy("_q_h").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures"))
    r = F.col("host_failures") / F.col("host_docs")
    got = hosts.agg(F.avg(r).alias("m"), F.var_pop(r).alias("v"), F.avg(1 / F.col("host_docs")).alias("i")).first()  # three numbers
    m, v, noise = got.m or 0.0, got.v or 0.0, (got.m or 0.0) * (1 - (got.m or 0.0)) * (got.i or 0.0)
    s = min(10000.0, max(1.0, m * (1 - m) / (v - noise) - 1)) if v > noise else 10000.0
    return hosts.withColumn("host_rate", (F.col("host_failures") + m * s) / (F.col("host_docs") + F.lit(s)))


def join_verdicts(x: DataFrame, verdicts: DataFrame, max_rate: float) -> DataFrame:
    """Rows of x with their host's verdict; the planner splits a hot host's side of the join, or broadcasts the hosts if they are few."""
    out = x.join(verdicts, "_q_h").withColumn("host_ok", F.col("host_rate") <= max_rate)
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("_q_h")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host rules over all documents; the source stands for the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    x = host_rules(docs)
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "source", "host_docs", "host_failures", F.round("host_rate", 9).alias("host_rate"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS row FROM documents),
g AS (SELECT row, i, w[i:i + 4] AS gram FROM d, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) > 4),
again AS (SELECT row, i FROM g QUALIFY count(*) OVER (PARTITION BY row, gram) > 1),
rep AS (SELECT row, count(DISTINCT i + j) AS n FROM again, unnest(range(5)) AS u(j) GROUP BY row),
lin AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM lin WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
f AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (row) LEFT JOIN dup USING (row)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(source, chr(0)) AS h FROM f),
hosts AS (SELECT h, count(*) AS host_docs, sum(base_failed::INT)::BIGINT AS host_failures FROM b GROUP BY h),
m AS (SELECT avg(host_failures / host_docs) AS m, var_pop(host_failures / host_docs) AS v, avg(1.0::DOUBLE / host_docs) AS i FROM hosts),
s AS (SELECT m, CASE WHEN v > m * (1 - m) * i THEN least(10000, greatest(1, m * (1 - m) / (v - m * (1 - m) * i) - 1)) ELSE 10000 END AS s FROM m),
r AS (SELECT h, host_docs, host_failures, (host_failures + m * s) / (host_docs + s) AS rate FROM hosts, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept, source, host_docs, host_failures, round(rate, 9) AS host_rate FROM b JOIN r USING (h)
"""
