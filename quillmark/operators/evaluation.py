"""Retrieval and answer metrics, gates and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Fixed gates: least means, and two greatest rates.
GATES = {
    "groundedness_min": 0.80, "hallucination_rate_max": 0.05, "acl_leakage_max": 0.0, "citation_coverage_min": 0.90, "refusal_correctness_min": 0.95,
    "context_relevance_min": 0.75, "answer_relevance_min": 0.80,
}
#: Fixed phrases of a refusal.
REFUSALS = ("i don't know", "i cannot", "i don't have", "i'm not able", "i cannot provide", "i don't have access", "i'm unable", "not available", "cannot answer")


def retrieval(retrieved: DataFrame, expected: DataFrame, k: int = 10, p_at: int = 5) -> DataFrame:
    """query_id, mrr, ndcg, hit, recall, precision of retrieved (query_id, rank, id) against expected (query_id, id).

    Both sides are rows, joined on (query, id): nothing is collected. A retrieved duplicate counts twice. Queries without expected or retrieved rows score 0.
    """
    need = expected.distinct()
    n = need.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return retrieval_of(retrieved.join(need.withColumn("rel", F.lit(True)), ["query_id", "id"], "left").select("query_id", "rank", F.coalesce("rel", F.lit(False)).alias("rel")), n, k, p_at)


def retrieval_of(hit: DataFrame, n: DataFrame, k: int = 10, p_at: int = 5) -> DataFrame:
    """As `retrieval`, from retrieved rows (query_id, rank, rel) that are marked already and the number of expected ones (query_id, n): where relevance is
    a property that both sides have, expected rows need not be listed."""
    rel = F.col("rel")
    g = hit.groupBy("query_id").agg(
        F.min(F.when(rel, F.col("rank"))).alias("first"), F.sum(F.when(rel & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.count_if(rel & (F.col("rank") <= k)).alias("in_k"), F.count_if(rel & (F.col("rank") <= p_at)).alias("in_p"),
    )
    x = n.join(g, "query_id", "full_outer")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return x.select(
        "query_id", F.round(zero(1 / F.col("first")), 6).alias("mrr"), F.round(zero(F.col("dcg") / ideal), 6).alias("ndcg"), zero(F.when(F.col("in_k") > 0, 1.0)).alias("hit"),
        F.round(zero(F.col("in_k") / F.col("n")), 6).alias("recall"), F.round(zero(F.col("in_p") / F.lit(p_at)), 6).alias("precision"),
    )


def wordset(c: Column) -> Column:
    return F.array_distinct(T.words(F.lower(c)))


def claims(answer: Column, least: int = 20, most: int = 10) -> Column:
    return F.slice(F.filter(F.transform(F.split(answer, "[.!?]+"), T.stripped), lambda s: F.length(s) > least), 1, most)


def grounded(claim: Column, chunk: Column) -> Column:
    """Over 30 % of a claim's words are in the chunk."""
    return F.size(F.array_intersect(wordset(claim), wordset(chunk))) / F.greatest(F.size(wordset(claim)), F.lit(1)) > 0.3


def context_relevance(query: Column, chunks: Column) -> Column:
    """Share of an array of chunks that hold over 30 % of the query's words; 0 without a query or chunks."""
    q = wordset(query)
    near = F.filter(chunks, lambda c: F.size(F.array_intersect(q, wordset(F.coalesce(c, F.lit(""))))) / F.greatest(F.size(q), F.lit(1)) > 0.3)
    return F.when(F.coalesce((F.size(q) > 0) & (F.size(chunks) > 0), F.lit(False)), F.size(near) / F.size(chunks)).otherwise(0.0)


def context_similarity(cosines: Column) -> Column:
    """The same by embeddings: the mean of the chunks' cosines with the query, within 0 and 1; 0 without any."""
    n = F.size(cosines)
    return F.when(F.coalesce(n > 0, F.lit(False)), T.clip(F.aggregate(cosines, F.lit(0.0), lambda a, c: a + c) / n)).otherwise(0.0)


def documents_found(retrieved: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """query_id, doc_recall_at_<k> and doc_hit_at_<k> of retrieved (query_id, rank, path) against expected (query_id, doc).

    A document is the last part of its path and counts where it comes first, so places are those among different documents. Queries without expected documents are left out.
    """
    name = F.element_at(F.split("path", "/"), -1)
    first = retrieved.filter("path IS NOT NULL AND path <> ''").groupBy("query_id", name.alias("doc")).agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc"))
    hit = expected.distinct().join(first.withColumn("place", place).select("query_id", "doc", "place"), ["query_id", "doc"], "left")
    share = lambda k: F.count_if(F.col("place") <= k)
    return hit.groupBy("query_id").agg(*[c for k in ks for c in (F.round(share(k) / F.count(F.lit(1)), 6).alias(f"doc_recall_at_{k}"), (share(k) > 0).cast("double").alias(f"doc_hit_at_{k}"))])


#: Fixed criteria by type of question: whether citations are required, whether refusing is fine, least groundedness.
QUESTION_TYPES = {
    "factual": (True, False, 0.85), "summarization": (True, False, 0.80), "policy": (True, True, 0.90), "synthesis": (True, False, 0.80),
    "adversarial": (False, True, 0.95), "comparison": (True, False, 0.80), "causal": (True, False, 0.80), "temporal": (True, False, 0.85),
}
#: Fixed weights of metrics in an overall score.
RUBRIC_WEIGHTS = {"groundedness": 0.30, "relevance": 0.25, "citation_coverage": 0.20, "refusal_correctness": 0.15, "hallucination_rate": 0.10}


def rubric(kind: Column, answer: Column, citations: Column, denied: Column, expected_refusal: Column) -> Column:
    """struct(passed, score, violations) of an answer by the type of its question; citations is their number. Types that aren't known ask for citations.

    A policy question that was denied as expected is right as it is; other types fail. Then missing citations take half of the score, an answer that should have been
    refused 0.7 of it, and a long answer without citations 0.3. Phrases of refusal are looked for in any case.
    """
    needs = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in QUESTION_TYPES.items() for x in (F.lit(k), F.lit(v[0]))]), kind), F.lit(True))
    none, low = F.coalesce(citations, F.lit(0)) == 0, F.lower(F.coalesce(answer, F.lit("")))
    refused = F.contains(low, F.lit("i don't know")) | F.contains(low, F.lit("i cannot"))
    right = denied & expected_refusal & (kind == "policy")
    marks = [
        (denied & expected_refusal, "Unexpected ACL denial", 0.0), (needs & none, "Missing citations", 0.5), (expected_refusal & ~denied & ~refused, "Should have refused but didn't", 0.3),
        (none & (F.length(low) > 50), "Potential hallucination (no citations)", 0.7),
    ]
    score = F.lit(1.0)
    for when, _, by in marks:
        score = score * F.when(when, by).otherwise(1.0)
    failed = marks[0][0] | marks[1][0] | marks[2][0]
    said = F.array_compact(F.array(*[F.when(when, name) for when, name, _ in marks]))
    return F.when(right, F.struct(F.lit(True).alias("passed"), F.lit(1.0).alias("score"), F.array().cast("array<string>").alias("violations"))).otherwise(F.struct((~failed).alias("passed"), F.round(score, 6).alias("score"), said.alias("violations")))


def answer_relevance(query: Column, answer: Column) -> Column:
    q = wordset(query)
    cover = F.size(F.array_intersect(q, wordset(answer))) / F.greatest(F.size(q), F.lit(1))
    return F.when((query == "") | (answer == ""), 0.0).otherwise(F.least(F.lit(1.0), cover * 0.7 + F.least(F.lit(1.0), F.length(answer) / 100.0) * 0.3))


def answer_correctness(expected: Column, answer: Column) -> Column:
    """Word overlap (Jaccard); null without an expected answer."""
    e, a = wordset(expected), wordset(answer)
    return F.when(expected != "", F.size(F.array_intersect(e, a)) / F.greatest(F.size(F.array_union(e, a)), F.lit(1)))


def is_refusal(answer: Column, denied: Column) -> Column:
    low = F.lower(answer)
    said = F.lit(False)
    for p in REFUSALS:
        said = said | F.contains(low, F.lit(p))
    return denied | (answer == "") | said


def refusal_correctness(answer: Column, denied: Column, expected: Column, evidence: Column) -> Column:
    should, did = expected | (denied & ~evidence), is_refusal(answer, denied)
    return F.when(should == did, 1.0).when(should, 0.0).otherwise(0.3)


def citation_coverage(answer: Column, citations: Column, chunk_ids: Column, most: int = 15) -> Column:
    """The first `most` claims count, as is the metric's rule. By the form of citation: ids without marks give the share of valid ids; marks give 0.7 of the claims near one and 0.3 of that share; neither gives the claims' part."""
    marks = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(0)))
    parts = F.slice(F.filter(F.transform(F.split(answer, r"[.!?]+\s+"), T.stripped), lambda s: F.length(s) > 15), 1, most)

    def near(c: Column) -> Column:
        at = F.instr(answer, c)
        return F.exists(marks, lambda m: (F.instr(answer, m) > 0) & (F.instr(answer, m) >= at - 100) & (F.instr(answer, m) <= at + F.length(c) + 100))

    covered = F.when(F.size(parts) == 0, 1.0).otherwise(F.size(F.filter(parts, near)) / F.greatest(F.size(parts), F.lit(1)))
    valid = F.when(F.size(citations) > 0, F.size(F.filter(citations, lambda c: F.array_contains(chunk_ids, c))) / F.greatest(F.size(citations), F.lit(1))).otherwise(0.0)
    return F.when((F.size(citations) > 0) & (F.size(marks) == 0), valid).when(F.size(marks) > 0, covered * 0.7 + valid * 0.3).otherwise(covered)


def aggregates(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, min, max, n over rows; null scores are left out. One unpivot, one sum."""
    x = scores.unpivot([], metrics, "metric", "value") if scores.columns else scores
    return x.filter("value IS NOT NULL").groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))


def gates(agg: DataFrame, rates: dict[str, Column], thresholds: dict[str, float] | None = None) -> DataFrame:
    """gate, threshold, actual, passed: means against least values, a missing metric fails; `rates` are columns of agg's totals for the greatest ones."""
    spark = agg.sparkSession
    t = spark.createDataFrame([(g, v, g.removesuffix("_min")) for g, v in (thresholds or GATES).items() if g.endswith("_min")], "gate string, threshold double, metric string")
    low = t.join(agg.select("metric", F.col("mean").alias("actual")), "metric", "left").select("gate", "threshold", "actual", F.coalesce(F.col("actual") >= F.col("threshold"), F.lit(False)).alias("passed"))
    for g, c in rates.items():
        v = (thresholds or GATES)[g]
        low = low.unionByName(agg.agg(c.alias("actual")).select(F.lit(g).alias("gate"), F.lit(v).alias("threshold"), "actual", F.coalesce(F.col("actual") <= v, F.lit(False)).alias("passed")))
    return low


def run_gates(metrics: DataFrame, overrides: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """run_id, gate, threshold, actual, passed for all gates of each run, and all_passed of the run: defaults, replaced by the product's own thresholds.

    metrics: run_id, product_id, metric, value; overrides: product_id, gate, threshold. A gate is named by its metric and _min or _max. A metric that is missing or null fails, a null override doesn't count.
    """
    gates = F.array(*[F.struct(F.lit(g).alias("gate"), F.lit(float(v)).alias("default")) for g, v in (defaults or GATES).items()])
    runs = metrics.select("run_id", "product_id").distinct().select("run_id", "product_id", F.inline(gates))
    x = runs.join(overrides.select("product_id", "gate", F.col("threshold").alias("_t")), ["product_id", "gate"], "left").withColumn("threshold", F.coalesce("_t", "default"))
    x = x.withColumn("metric", F.regexp_replace("gate", "_(?:min|max)$", "")).join(metrics.select("run_id", "metric", F.col("value").alias("actual")), ["run_id", "metric"], "left")
    ok = F.when(F.endswith("gate", F.lit("_min")), F.col("actual") >= F.col("threshold")).otherwise(F.col("actual") <= F.col("threshold"))
    x = x.withColumn("passed", F.coalesce(ok, F.lit(False)))
    return x.withColumn("all_passed", F.bool_and("passed").over(Window.partitionBy("run_id"))).select("run_id", "gate", "threshold", "actual", "passed", "all_passed")


def trend(runs: DataFrame, by: list[str], value: str, at: str, passed: Column) -> DataFrame:
    """mean, min, max, first, last, direction and pass rate of a metric's runs over time."""
    g = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.min_by(value, F.struct(at, value)).alias("first"), F.max_by(value, F.struct(at, value)).alias("last"),
        F.round(F.avg(passed.cast("double")), 6).alias("pass_rate"),
    )
    return g.withColumn("direction", F.when(F.col("last") > F.col("first"), "improving").when(F.col("last") < F.col("first"), "declining").otherwise("stable"))


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two runs side by side: difference and per cent, missing ones null."""
    x = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full_outer")
    return x.withColumn("diff", F.col("b") - F.col("a")).withColumn("percent", F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.col("a") * 100))
