"""Settings of many products at once: layers stacked as rows, folded by rank, each field with the layer it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed defaults of the fields that have one.
DEFAULTS = {"chunk_size": "1000", "chunk_overlap": "200", "min_chunk_size": "100", "max_chunk_size": "2000", "chunking_strategy": "fixed_size"}
NUMBERS = ("chunk_size", "chunk_overlap", "min_chunk_size", "max_chunk_size")
FIELDS = (*DEFAULTS, "content_type", "source_quality")
#: Fixed order of the layers, weakest first, and the names that a trace gives them. Of the three of rank 4 a product has one.
LAYERS = {
    "playbook": (1, "playbook_defaults"), "kind": (2, "content_type_defaults"), "manual": (3, "product_manual_settings"), "stored": (4, "force_product_chunking_config"),
    "resolved": (4, "resolved_settings"), "run_resolved": (4, "resolved_settings"), "run": (5, "run_conf"), "run_direct": (6, "run_conf"),
}
#: Sides of a join up to so many rows are broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 100_000


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _given(c: str) -> Column:
    """A name that isn't null or empty."""
    return F.nullif(F.col(c), F.lit(""))


def playbook_key(c: Column) -> Column:
    """Upper case without separators, as playbooks are looked up."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def playbook_rows(spark: SparkSession, books: dict) -> DataFrame:
    """(playbook, field, value) of playbooks: four characters a token, the overlap in characters, sentence packing as the semantic strategy."""
    rows = []
    for p in books.values():
        rows += [(p.name, "chunk_size", str(p.max_tokens * 4)), (p.name, "chunk_overlap", str(p.overlap_chars)), (p.name, "chunking_strategy", "semantic" if p.strategy == "sentence" else "fixed_size")]
    return spark.createDataFrame(rows, "playbook string, field string, value string")


def kind_rows(spark: SparkSession, setups: dict) -> DataFrame:
    """(kind, field, value) of the kinds of content."""
    names = (*NUMBERS, "chunking_strategy")
    return spark.createDataFrame([(k, f, str(v)) for k, s in setups.items() for f, v in zip(names, s, strict=True)], "kind string, field string, value string")


def resolve_products(products: DataFrame, own: DataFrame, playbooks: DataFrame, kinds: DataFrame, default_playbook: str = "TECH") -> DataFrame:
    """A row per product: every field's value, and as <field>_from the layer that gave it.

    products: product_id, run_playbook, detected_playbook, playbook, kind (found by content), extraction_type, mode, forced, confidence_met. own: (product_id, layer, field,
    value), layer one of LAYERS. playbooks and kinds: rows as of `playbook_rows` and `kind_rows`, from any table.

    The playbook is the run's, else the detected one, else the product's, else the default; a name that no playbook has takes the default's values. Layers are stacked as rows
    and the one of the highest rank gives each field. A forced product adds one layer: what its run resolved, if that has a size; else what the product resolved, if its mode
    is auto (or null) and it has a size or met its confidence; else the product's stored fields. Of resolved layers, sizes of 0 and empty names don't count. An overlap that isn't under
    the size becomes size - 1, from `guard`. A content type `scanned` is `general`; its trace names where the type was found, and layers that only replace it leave the trace.

    One shuffle by product (own is summed and folded under one partitioning); the tables of playbooks and kinds are joined by broadcast only if counted to be small. Nulls: null
    values and fields or layers of other names are no settings; a null product_id is no product; products without own rows take defaults. Numbers that don't parse are left
    out. Of several values of one layer and field the greatest text counts. Repeated products are an error of the caller: each gives its row. An empty table gives an empty result.
    """
    p = products.filter("product_id IS NOT NULL")
    picked = [("run_conf", "run_playbook"), ("detected_playbook", "detected_playbook"), ("product", "playbook")]
    name = F.coalesce(*[_given(c) for _, c in picked], F.lit(default_playbook))
    source = F.coalesce(*[F.when(_given(c).isNotNull(), n) for n, c in picked], F.lit("global_default"))
    books = playbooks.select(playbook_key(F.col("playbook")).alias("_key"), "field", "value")
    keys = books.select("_key").distinct()
    p = p.select("*", name.alias("_playbook"), source.alias("_playbook_from"))
    p = p.withColumn("_named", playbook_key(F.col("_playbook"))).join(_bounded(keys), F.col("_named") == F.col("_key"), "left")
    p = p.withColumn("_book", F.coalesce("_key", F.lit(default_playbook))).drop("_key", "_named")
    typed = books.filter("field = 'content_type'").groupBy(F.col("_key").alias("_book")).agg(F.max("value").alias("_book_kind"))
    p = p.join(_bounded(typed), "_book", "left")
    p = p.withColumn("_kind", F.coalesce(_given("kind"), _given("_book_kind"), F.lit("general")))
    p = p.withColumn("_kind_from", F.when(_given("kind").isNotNull(), "product_auto_settings").when(_given("_book_kind").isNotNull(), "playbook").otherwise("global_default"))

    rank = F.create_map(*[F.lit(x) for n, (r, _) in LAYERS.items() for x in (n, r)])
    label = F.create_map(*[F.lit(x) for n, (_, s) in LAYERS.items() for x in (n, s)])
    lookup = [
        p.join(_bounded(books.withColumnRenamed("_key", "_book")), "_book").select("product_id", F.lit("playbook").alias("layer"), "field", "value"),
        p.join(_bounded(kinds.withColumnRenamed("kind", "_kind")), "_kind").select("product_id", F.lit("kind").alias("layer"), "field", "value"),
    ]
    rows = own.select("product_id", "layer", "field", F.col("value").cast("string").alias("value"))
    for x in lookup:
        rows = rows.unionByName(x)
    number = F.col("field").isin(*NUMBERS)
    rows = rows.filter(F.col("layer").isin(*LAYERS) & F.col("field").isin(*FIELDS) & F.col("value").isNotNull() & (~number | F.expr("try_cast(value AS int)").isNotNull()))
    facts = p.select("product_id", F.coalesce("forced", F.lit(False)).alias("forced"), F.coalesce("mode", F.lit("auto")).alias("mode"), F.coalesce("confidence_met", F.lit(False)).alias("met")).distinct()
    every = Window.partitionBy("product_id")
    has = lambda layer: F.coalesce(F.max((F.col("layer") == layer) & (F.col("field") == "chunk_size")).over(every), F.lit(False))
    rows = rows.join(facts, "product_id").withColumn("_run", has("run_resolved")).withColumn("_own", (F.col("mode") == "auto") & (has("resolved") | F.col("met")))
    chosen = F.when(~F.col("forced"), F.lit(None)).when(F.col("_run"), "run_resolved").when(F.col("_own"), "resolved").otherwise("stored")
    loose = F.col("field").isin("chunk_overlap", "source_quality")
    empty = F.col("layer").isin("resolved", "run_resolved") & ~loose & F.when(number, F.expr("try_cast(value AS int)") == 0).otherwise(F.col("value") == "")
    level = F.element_at(rank, F.col("layer"))
    rows = rows.filter(((level != 4) | F.coalesce(F.col("layer") == chosen, F.lit(False))) & ~empty)

    best = [F.max(F.when(F.col("field") == f, F.struct(level.alias("r"), F.col("value").alias("v"), F.element_at(label, F.col("layer")).alias("s")))).alias(f"_{f}") for f in FIELDS]
    traced = F.max((F.col("field") == "content_type") & F.col("layer").isin("resolved", "run_resolved")).alias("_traced")
    folded = rows.groupBy("product_id").agg(*best, traced)
    x = p.join(folded, "product_id", "left")
    number_of = lambda f: F.coalesce(F.col(f"_{f}.v"), F.lit(DEFAULTS[f])).cast("int")
    late = number_of("chunk_overlap") >= number_of("chunk_size")
    kind = F.coalesce(F.col("_content_type.v"), F.col("_kind"))
    scan = F.lower(F.trim("extraction_type"))
    quality = F.when(scan == "scanned_pdf", "scanned_ocr").when(scan == "mixed", "mixed").otherwise("native_pdf")
    out = [F.col("product_id"), F.col("_playbook").alias("playbook_id"), F.col("_playbook_from").alias("playbook_from")]
    for f in DEFAULTS:
        value = number_of(f) if f in NUMBERS else F.coalesce(F.col(f"_{f}.v"), F.lit(DEFAULTS[f]))
        layer = F.coalesce(F.col(f"_{f}.s"), F.lit("global_default"))
        if f == "chunk_overlap":
            value, layer = F.when(late, F.greatest(F.lit(0), number_of("chunk_size") - 1)).otherwise(value), F.when(late, "guard").otherwise(layer)
        out += [value.alias(f), layer.alias(f"{f}_from")]
    out += [F.when(F.lower(F.trim(kind)) == "scanned", "general").otherwise(kind).alias("content_type"), F.when(F.col("_traced"), "resolved_settings").otherwise(F.col("_kind_from")).alias("content_type_from")]
    return x.select(*out, F.coalesce(F.col("_source_quality.v"), quality).alias("source_quality"))


def confident_settings(settings: DataFrame, confidence_met: str, confidence: str, analysis_confidence: str, threshold: float = 0.7) -> DataFrame:
    """Settings whose detection is in doubt keep their sizes but cut fixed windows of general text; adds fell_back. A null confidence is no doubt, confidence_met only if it is false."""
    low = F.coalesce(~F.col(confidence_met), F.lit(False)) | F.coalesce(F.col(confidence) < threshold, F.lit(False)) | F.coalesce(F.col(analysis_confidence) < threshold, F.lit(False))
    pick = lambda c, v: F.when(F.col("fell_back"), v).otherwise(F.col(c))
    return settings.withColumn("fell_back", low).withColumn("chunking_strategy", pick("chunking_strategy", "fixed_size")).withColumn("content_type", pick("content_type", "general"))
