"""Retrieval around a vector search: filters, access, boosts, context windows, score cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .models import Score, rerank
from .vectors import top_k as top_k_of

#: Fixed expansions of abbreviations and medical terms.
EXPANSIONS = {
    r"\baws\b": ("amazon web services", "amazon web service"), r"\bceo\b": ("chief executive officer", "chief executive"), r"\bcto\b": ("chief technology officer", "chief technical officer"),
    r"\bcfo\b": ("chief financial officer",), r"\bcio\b": ("chief information officer",), r"\bapi\b": ("application programming interface",), r"\bsdk\b": ("software development kit",),
    r"\bui\b": ("user interface",), r"\bux\b": ("user experience",), r"\bqa\b": ("quality assurance",), r"\bdevops\b": ("development operations",),
}
MEDICAL = {
    r"\btype\s+1\b": ("type i", "type one", "insulin dependent", "iddm"), r"\btype\s+2\b": ("type ii", "type two", "non-insulin dependent", "niddm", "adult onset"),
    r"\bdiabetes\b": ("diabetic", "diabetes mellitus", "dm"), r"\bdiabetic\b": ("diabetes", "diabetes mellitus"),
}


def expand(query: Column) -> Column:
    """Distinct sorted terms: the query, what its abbreviations stand for, and words of over three letters once these are written out."""
    low, terms = F.lower(query), [F.array(F.lower(query))]
    out = low
    for table, write in ((EXPANSIONS, True), (MEDICAL, False)):
        for pattern, means in table.items():
            terms.append(F.when(F.rlike(low, F.lit(pattern)), F.array(*map(F.lit, means))).otherwise(F.array().cast("array<string>")))
            if write:
                out = F.regexp_replace(out, pattern, means[0])
    long = F.filter(F.regexp_extract_all(out, F.lit(r"(?U)\b\w+\b"), F.lit(0)), lambda w: F.length(w) > 3)
    return F.array_sort(F.array_distinct(F.concat(*terms, long)))


#: Fixed patterns of questions for the head of two firms: in the query, in the text, the boost; the second text pattern and boost are for a mere mention.
ENTITIES = (
    (r"\b(?:ceo|chief executive officer)\b.*?\b(?:of|for)\b.*?\b(aws|amazon web services)\b", r"\b(?:ceo|chief executive officer)\b.*?\b(?:amazon web services|aws)\b", 0.10, r"\b(?:aws|amazon web services)\b", 0.05),
    (r"\b(?:ceo|chief executive officer)\b.*?\b(?:of|for)\b.*?\bamazon\b", r"\b(?:ceo|chief executive officer)\b.*?\b(?:amazon\.com|amazon inc)\b", 0.08, None, 0.0),
)


def entity_boost(low: Column, query: Column) -> Column:
    """For the first pattern that the query matches, what the text gets; both in lower case."""
    out = F.lit(0.0)
    for asked, said, full, named, some in reversed(ENTITIES):
        part = F.when(F.rlike(low, F.lit(named)), some).otherwise(0.0) if named else F.lit(0.0)
        out = F.when(F.rlike(query, F.lit(asked)), F.when(F.rlike(low, F.lit(said)), full).otherwise(part)).otherwise(out)
    return out


def keyword_boost(text: Column, terms: Column, query: Column) -> Column:
    """-0.30 to 0.15: the phrase, the coverage of longer terms, whole-word hits, less a penalty for a bare heading."""
    low, t = F.lower(text), T.stripped(text)
    w = T.words(t)
    titled = F.size(F.filter(w, lambda x: F.rlike(x, F.lit(r"^(?:\p{Lu}|[^\p{L}])")))) / F.greatest(F.size(w), F.lit(1))
    heading = (F.length(t) < 150) & (F.size(F.split(t, "\n")) <= 2) & (titled > 0.8)
    penalty = F.when(heading & (F.length(t) < 50), -0.30).when(heading, -0.20).otherwise(0.0)
    long = F.filter(terms, lambda x: F.length(x) > 4)
    cover = F.when(F.size(long) > 0, F.size(F.filter(long, lambda x: F.contains(low, x))) / F.greatest(F.size(long), F.lit(1)) * 0.05).otherwise(0.0)
    # A term between spaces of a text whose other signs are spaces is a whole word; split counts its places.
    plain = F.concat(F.lit(" "), F.regexp_replace(low, r"(?U)\W+", "  "), F.lit(" "))
    each = F.transform(terms, lambda x: F.least(F.lit(3), F.floor((F.length(plain) - F.length(F.replace(plain, F.concat(F.lit(" "), x, F.lit(" ")), F.lit("")))) / (F.length(x) + 2)).cast("int")))
    hits = F.aggregate(each, F.lit(0), lambda a, b: a + b)
    boost = F.when(F.contains(low, F.lower(query)), 0.08).otherwise(0.0) + cover + F.least(hits * 0.02, F.lit(0.05)) + entity_boost(low, F.lower(query))
    return F.greatest(F.least(boost + penalty, F.lit(0.15)), F.lit(-0.30))


def payload_filter(df: DataFrame, wanted: dict) -> DataFrame:
    """Rows where every column equals its value, or one of a list's values; pushed down to the scan where it can be."""
    for c, v in wanted.items():
        df = df.filter(F.col(c).isin(*v) if isinstance(v, list | tuple | set) else F.col(c) == F.lit(v))
    return df


def visible(points: DataFrame, acls: DataFrame, user: str, chunk: str = "chunk_id") -> DataFrame:
    """The distinct chunks of points (chunk, product_id, document_id, field_name) that a user's rules (user_id, access_type, index_scope,
    doc_scope, field_scope) let him see; nobody without a rule sees any.

    Rules of one user are few and checked to be; index and document rules are semi-joins on split scopes, field rules match either way as parts of
    names, so the four kinds are united by chunk instead of one join on a disjunction.
    """
    mine = acls.filter(F.col("user_id") == user)
    scope = lambda c: F.explode(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: F.trim(x)))
    index = mine.filter("access_type = 'index'").select(scope("index_scope").alias("product_id")).filter("product_id <> ''").distinct()
    document = mine.filter("access_type = 'document'").select(scope("doc_scope").alias("document_id")).filter("document_id <> ''").distinct()
    field = mine.filter("access_type = 'field'").select(F.lower("field_scope").alias("s"))
    field = field.select(F.explode(F.transform(F.split(F.coalesce(F.col("s"), F.lit("")), ","), lambda x: F.trim(x))).alias("s")).filter("s <> ''").distinct()
    f = F.lower(F.trim(F.col("field_name")))
    if mine.limit(10_001).count() > 10_000 or field.limit(10_001).count() > 10_000:
        raise ValueError("one user has too many rules")
    full = mine.filter("access_type = 'full'").select("user_id").limit(1)
    parts = [
        points.join(full, F.lit(True), "left_semi"), points.join(index, "product_id", "left_semi"), points.join(document, "document_id", "left_semi"),
        points.join(F.broadcast(field), F.contains(f, F.col("s")) | F.contains(F.col("s"), f), "left_semi"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*points.columns))
    return out.dropDuplicates([chunk])


def context_window(hits: DataFrame, by: list[str], text: str, k: int, budget: int, order: list[str], first: list[str]) -> DataFrame:
    """The chunks of each context: equal texts once (the first by `first`), the first k of them, in `order`, up to a budget of length // 4 tokens; the first chunk is always in."""
    norm = F.lower(T.squeezed(F.col(text)))
    tok = F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in hits.columns])
    x = hits.filter(F.coalesce(F.col(text), F.lit("")) != "").withColumn("_r", row)
    # Windows see narrow rows; the few that are left take their other columns from the hits.
    n = x.select(*dict.fromkeys([*by, *first, *order]), "_r", F.md5(norm).alias("_n"), tok.alias("tokens"))
    n = n.withColumn("_d", F.row_number().over(Window.partitionBy(*by, "_n").orderBy(*first, "_r"))).filter("_d = 1")
    n = n.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*first, "_r"))).filter(F.col("_k") <= k)
    run = Window.partitionBy(*by).orderBy(*order, "_r")
    n = n.withColumn("total_tokens", F.sum("tokens").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(run))
    n = n.filter((F.col("total_tokens") <= budget) | (F.col("place") == 1)).select(F.col("_r").alias("_q"), "tokens", "total_tokens", "place")
    return x.join(n, F.col("_r") == F.col("_q")).dropDuplicates(["_r"]).drop("_r", "_q")


def freshness(stamp: Column, as_of: Column) -> Column:
    """100 for now, half of it each year."""
    return F.round(F.pow(F.lit(0.5), (F.unix_timestamp(as_of) - F.unix_timestamp(stamp)) / 86400.0 / 365) * 100, 1)


def score_cascade(chunks: DataFrame, scores: DataFrame, endings: tuple[str, ...] = (".jsonl", ".json", ".txt")) -> DataFrame:
    """chunk_id, trust: the score by (file, chunk), then for the file's name with each of the endings in turn by (file, chunk) and by (file, section), else by chunk, else
    by (file, section), else the file's best, else 0.

    Each step is an equi-join against scores reduced to one row per key, so a match never multiplies rows.
    """
    best = lambda *k: scores.groupBy(*k).agg(F.max("score").alias("_s"))
    stem = F.regexp_replace("file", r"\.(?:jsonl|json|txt)$", "")
    names = {"file": F.col("file")} | {f"_f{i}": F.concat(stem, F.lit(e)) for i, e in enumerate(endings)}
    x = chunks.withColumns({k: v for k, v in names.items() if k != "file"})
    steps = [("file", "chunk_id")] + [(f, c) for f in names if f != "file" for c in ("chunk_id", "section")] + [(None, "chunk_id"), ("file", "section"), ("file", None)]
    for i, (f, c) in enumerate(steps):
        keys = [k for k in ("file" if f else None, c) if k]
        b = best(*keys).withColumnsRenamed({"file": f"_k{i}", "_s": f"_s{i}"} | ({c: f"_c{i}"} if c else {}))
        on = [F.col(f) == F.col(f"_k{i}")] if f else []
        x = x.join(b, on + ([F.col(c) == F.col(f"_c{i}")] if c else []), "left").drop(f"_k{i}", f"_c{i}")
    return x.select("chunk_id", "file", "section", F.coalesce(*[f"_s{i}" for i in range(len(steps))], F.lit(0.0)).alias("trust"))


#: What every question must be confined to.
SCOPE = ("workspace_id", "product_id", "version", "collection_id")


def ask(queries: DataFrame, points: DataFrame, scope: dict, acls: DataFrame | None = None, user: str | None = None, model: Score | None = None, top_k: int = 5, depth: int = 50, budget: int = 3000) -> DataFrame:
    """The whole search: query_id, place, chunk_id, point_id, score, rerank_score, text, tokens, total_tokens of the chunks that answer each query.

    queries: query_id, query, embedding; points: point_id, chunk_id, embedding, text, document_id, field_name and the columns of SCOPE, all of which scope must name.
    The `depth` nearest points in scope, of each chunk the best, ranked again by the model if there is one, those that the user may see, the first min(5, top_k), and of
    different texts as many as fit the budget. Without rules for the user nothing is seen; without a user there is no access filter.
    """
    if missing := [c for c in SCOPE if c not in scope]:
        raise ValueError(f"a question must be confined by {missing}")
    p = payload_filter(points, scope)
    near = top_k_of(queries.select(F.col("query_id").alias("_id"), "embedding"), p.select(F.col("point_id").alias("_id"), "embedding"), depth, by="_id", same=True).withColumnRenamed("id", "point_id")
    hits = near.join(p.drop("embedding"), "point_id").join(queries.select("query_id", "query"), "query_id")
    one = hits.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("score"), "point_id"))).filter("_r = 1").drop("_r")
    if user is not None:
        seen = visible(p.select("chunk_id", "product_id", "document_id", "field_name"), acls, user).select("chunk_id").distinct()
        one = one.join(seen, "chunk_id", "left_semi")
    first = rerank(one.withColumn("_i", -F.col("rank")), ["query_id"], "query", "text", ["score", "_i"], model, min(5, top_k)).withColumnRenamed("place", "_p")
    out = context_window(first.drop("_i", "rank"), ["query_id"], "text", min(5, top_k), budget, ["_p"], ["_p"])
    return out.select("query_id", "place", "chunk_id", "point_id", "score", "rerank_score", "text", "tokens", "total_tokens")
