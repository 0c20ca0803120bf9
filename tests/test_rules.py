"""Settings folded by layers, ordered rules of advice, causes of failures, readiness of embeddings."""

from __future__ import annotations

import random

import pytest

from quillmark.operators import advice as A
from quillmark.operators import settings as S
from quillmark.operators import vectors as V
from quillmark.plans import config

PRODUCT = "product_id long, run_playbook string, detected_playbook string, playbook string, kind string, extraction_type string, mode string, forced boolean, confidence_met boolean"
OWN = "product_id long, layer string, field string, value string"


def resolved(spark, products, own, books=None):
    b = S.playbook_rows(spark, config.PLAYBOOKS)
    if books:
        b = b.unionByName(spark.createDataFrame(books, "playbook string, field string, value string"))
    x = S.resolve_products(spark.createDataFrame(products, PRODUCT), spark.createDataFrame(own, OWN), b, S.kind_rows(spark, config.SETUPS))
    return {r.product_id: r.asDict() for r in x.collect()}


def test_layers_of_settings(spark):
    none = (None,) * 8
    products = [
        (1, *none), (None, *none), (2, None, None, "tech", "scanned", "SCANNED_PDF", None, None, None), (3, None, "legal", "tech", "legal", "mixed", "auto", True, False),
        (4, "none such", "", "", None, None, "manual", True, True), (5, None, None, None, None, None, None, True, None), (6, None, None, "verse", None, None, None, False, None),
    ]
    own = [
        (2, "manual", "chunk_size", "300"), (2, "stored", "chunk_size", "1"), (2, "run", "chunk_overlap", "9000"),
        (3, "run_resolved", "chunk_size", "0"), (3, "run_resolved", "chunk_overlap", "0"), (3, "resolved", "chunk_size", "50"), (3, "run", "chunking_strategy", "paragraph"), (3, "run_direct", "chunking_strategy", "sentence"),
        (4, "resolved", "chunk_size", "50"), (4, "stored", "min_chunk_size", "7"), (4, "stored", "content_type", "code"), (4, "stored", "max_chunk_size", "x"), (4, "stored", "colour", "red"), (4, "other", "chunk_size", "3"),
        (5, "resolved", "chunk_size", "640"), (5, "resolved", "content_type", "Scanned"), (5, "resolved", "min_chunk_size", None), (5, "resolved", "source_quality", "poor"), (9, "run", "chunk_size", "5"),
    ]
    got = resolved(spark, products, own, [("VERSE", "content_type", "poem"), ("verse", "chunk_size", "77")])
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    one = got[1]
    assert one["playbook_id"] == "TECH" and one["playbook_from"] == "global_default" and one["chunk_size"] == 1000 and one["chunk_size_from"] == "content_type_defaults" and one["content_type"] == "general" and one["source_quality"] == "native_pdf"
    two = got[2]  # a kind without a setup lets the playbook through; an overlap that is too large is cut
    assert (two["chunk_size"], two["chunk_size_from"], two["chunk_overlap"], two["chunk_overlap_from"]) == (300, "product_manual_settings", 299, "guard")
    assert (two["chunking_strategy"], two["chunking_strategy_from"], two["content_type"], two["content_type_from"], two["source_quality"]) == ("semantic", "playbook_defaults", "general", "product_auto_settings", "scanned_ocr")
    assert (two["min_chunk_size"], two["min_chunk_size_from"]) == (100, "global_default")
    three = got[3]  # a run's size of 0 is a size, which chooses the layer, but no setting
    assert (three["playbook_id"], three["playbook_from"], three["chunk_size"], three["chunk_size_from"], three["chunk_overlap"], three["chunk_overlap_from"]) == ("legal", "detected_playbook", 1200, "content_type_defaults", 0, "resolved_settings")
    assert (three["chunking_strategy"], three["chunking_strategy_from"]) == ("sentence", "run_conf")
    four = got[4]
    assert (four["playbook_id"], four["playbook_from"], four["chunk_size_from"], four["min_chunk_size"], four["min_chunk_size_from"]) == ("none such", "run_conf", "content_type_defaults", 7, "force_product_chunking_config")
    assert (four["content_type"], four["content_type_from"], four["max_chunk_size"]) == ("code", "global_default", 2000)
    five = got[5]
    assert (five["chunk_size"], five["content_type"], five["content_type_from"], five["source_quality"]) == (640, "general", "resolved_settings", "poor")
    assert (got[6]["chunk_size"], got[6]["chunk_size_from"], got[6]["content_type"], got[6]["content_type_from"]) == (77, "playbook_defaults", "poem", "playbook")


def test_settings_of_nothing_and_repeats(spark):
    assert resolved(spark, [], []) == {}
    one = (1, None, None, None, None, None, None, True, None)
    assert resolved(spark, [one], [(1, "run", "chunk_size", "5"), (1, "run", "chunk_size", "44")])[1]["chunk_size"] == 5  # the greatest text of one layer
    assert S.resolve_products(spark.createDataFrame([one, one], PRODUCT), spark.createDataFrame([], OWN), S.playbook_rows(spark, config.PLAYBOOKS), S.kind_rows(spark, config.SETUPS)).count() == 2


def test_settings_against_a_loop(spark):
    r = random.Random(4)
    layers = list(S.LAYERS)[2:]
    products, own = [], []
    for i in range(120):
        products.append((i, None, None, None, r.choice(["legal", "code", "poem"]), None, r.choice(["auto", "manual", None]), r.random() < 0.7, r.random() < 0.3))
        own += [(i, y, f, str(r.choice([0, 40, 800, 5000]))) for y in layers for f in S.NUMBERS if r.random() < 0.4]
    got = resolved(spark, products, own)
    book = {"chunk_size": 3200, "chunk_overlap": 240}
    for i, *_, kind, _, mode, forced, met in products:
        said = {y: {f: int(v) for p, w, f, v in own if p == i and w == y} for y in layers}
        stack = [("global_default", {k: int(S.DEFAULTS[k]) for k in S.NUMBERS}), ("playbook_defaults", book), ("content_type_defaults", dict(zip(S.NUMBERS, config.SETUPS.get(kind, ()), strict=False))), ("product_manual_settings", said["manual"])]
        whole = lambda d: {k: v for k, v in d.items() if v or k == "chunk_overlap"}
        if forced and "chunk_size" in said["run_resolved"]:
            stack.append(("resolved_settings", whole(said["run_resolved"])))
        elif forced and mode != "manual" and (met or "chunk_size" in said["resolved"]):
            stack.append(("resolved_settings", whole(said["resolved"])))
        elif forced:
            stack.append(("force_product_chunking_config", said["stored"]))
        value, trace = {}, {}
        for name, layer in [*stack, ("run_conf", said["run"]), ("run_conf", said["run_direct"])]:
            value |= layer
            trace |= dict.fromkeys(layer, name)
        if value["chunk_overlap"] >= value["chunk_size"]:
            value["chunk_overlap"], trace["chunk_overlap"] = max(0, value["chunk_size"] - 1), "guard"
        assert {k: got[i][k] for k in S.NUMBERS} == value and {k: got[i][f"{k}_from"] for k in S.NUMBERS} == trace


def test_low_confidence_cuts_fixed_windows(spark):
    x = spark.createDataFrame([(1, True, 0.9, None, "semantic", "legal"), (2, False, None, None, "semantic", "legal"), (3, None, None, None, "semantic", "legal"), (4, True, 0.6, 0.9, "a", "b"), (5, None, 0.8, 0.69, "a", "b")], "id int, met boolean, c double, a double, chunking_strategy string, content_type string")
    got = [tuple(r) for r in S.confident_settings(x, "met", "c", "a").select("id", "chunking_strategy", "content_type", "fell_back").orderBy("id").collect()]
    low = ("fixed_size", "general", True)
    assert got == [(1, "semantic", "legal", False), (2, *low), (3, "semantic", "legal", False), (4, *low), (5, *low)]


FP = "id int, ai_trust double, secure double, metadata_completeness double, kb_ready double, completeness double, quality double, playbook string"


@pytest.fixture(scope="module")
def advised(spark):
    rows = [
        (1, 0.9, 1.0, 0.95, 0.9, 0.95, 0.9, "TECH"), (2, 0.4, 0.5, 0.7, 0.4, 0.5, 0.6, None), (3, 0.6, 0.92, 0.82, 0.6, 0.7, 0.8, "tech"), (4, 0.75, 0.97, 0.87, 0.8, 0.79, 0.85, "LEGAL"),
        (5, 0.82, 1.0, 0.9, 0.85, 0.9, 0.9, "Regulatory"), (6, None, None, None, None, None, None, "regulatory"), (7, 0.7, 1.0, 0.8, 0.5, 0.55, 0.9, "LEGAL"),
    ]
    x = A.advise(spark.createDataFrame(rows, FP)).withColumn("after", A.apply_actions(A.F.col("actions"), A.F.lit(300), A.F.lit(200), A.F.col("playbook")))
    return {r.id: r for r in x.collect()}


def test_bands_of_advice(advised):
    b = {i: r.bands for i, r in advised.items()}
    assert b[1] == ["general:within_ranges"] and not advised[1].actions
    assert b[2] == ["trust:below_threshold", "security:good", "metadata:below_threshold", "kb:below_threshold", "completeness:low", "quality:low", "policy:failed"]
    assert b[3] == ["trust:acceptable", "security:good", "metadata:acceptable", "kb:improvable", "completeness:acceptable", "quality:good", "policy:passed_below_0.8"]
    assert b[4] == ["trust:good", "security:excellent", "metadata:good", "kb:good", "completeness:good", "policy:passed_below_0.8"]
    assert b[5] == ["trust:good", "policy:passed_below_0.85"]
    assert b[6][0] == "trust:below_threshold" and b[6][-1] == "policy:failed"


def test_actions_of_advice(advised):
    names = {i: [a.action for a in r.actions] for i, r in advised.items()}
    assert names[2] == ["enhance_normalization", "increase_chunk_overlap", "extract_metadata", "switch_playbook", "switch_playbook", "increase_chunk_overlap", "enhance_normalization", "error_correction"]
    assert names[3] == ["apply_all_quality_improvements", "extract_metadata", "increase_chunk_overlap", "enhance_normalization", "error_correction", "apply_all_quality_improvements"]
    assert [a.priority for a in advised[3].actions] == ["medium", None, None, "medium", "medium", "high"] and advised[3].actions[2].config == {"increase_by_percent": "20", "min_overlap": "200"}
    assert advised[4].actions[-1].config["increase_overlap"] == "true" and "increase_overlap" not in advised[5].actions[-1].config
    assert advised[2].tweaks == ["force_metadata_extraction", "increase_chunk_overlap"] and advised[2].violations == ["low_trust(<0.5)", "security_not_full(<0.9)", "weak_metadata(<0.8)", "kb_not_ready(<0.5)"]
    assert (advised[2].playbooks, advised[2].next_playbook) == (["TECH", "SCANNED", "SCANNED"], "SCANNED") and advised[6].next_playbook == "SCANNED"
    assert (advised[3].playbooks, advised[3].next_playbook) == ([], "tech") and (advised[7].playbooks, advised[7].next_playbook) == (["TECH"], "LEGAL")


def test_advice_is_applied(advised):
    two = advised[2].after  # 200 -> 250 -> 0.9 of the size at most
    assert (two.chunk_overlap, two.playbook, two.enhanced_normalization, two.error_correction, two.extract_metadata, two.force_metadata, two.additional_fields) == (270, "SCANNED", True, True, True, True, True)
    assert advised[3].after.chunk_overlap == 337  # 250, 270 at most, a quarter more
    assert (advised[1].after.chunk_overlap, advised[1].after.playbook, advised[1].after.error_correction) == (200, "TECH", False)


def test_causes_by_details(spark):
    rows = [
        ("groundedness", 3, 2, True, 0, None, 1900, None, None), ("groundedness", 2, 2, True, 0, None, None, 450, None), ("groundedness", None, None, None, None, None, None, None, None), ("citation_coverage", 9, 0, True, 1, None, None, None, None),
        ("citation_coverage", 0, 0, None, 0, None, 500, None, None), ("refusal_correctness", 0, 0, None, 0, True, None, None, None), ("refusal_correctness", 0, 0, None, 0, None, None, None, None), ("answer_relevance", 0, 0, None, 0, None, None, None, "mpnet"),
        ("context_relevance", 0, 0, None, 0, None, None, None, None), ("latency", 0, 0, None, 0, None, None, None, None), (None, 0, 0, None, 0, None, None, None, None),
    ]
    x = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, metric string, unsupported_claims long, supported_claims long, citation_issues boolean, invalid_citations long, acl_denied boolean, chunk_size int, chunk_overlap int, embedder string")
    got = [(r.cause, r.action, r.value, r.priority) for r in A.diagnose(x).orderBy("i").collect()]
    other = ("review_pipeline", None, "low")
    assert got == [
        ("chunk_boundaries", "increase_chunk_size", "2000", "medium"), ("chunk_overlap", "increase_chunk_overlap", "500", "high"), ("retrieval_quality", *other), ("citation_format", *other), ("chunk_boundaries", "increase_chunk_size", "700", "medium"),
        ("acl_config", "review_acl_config", None, "high"), ("prompt_template", "update_prompt_template", None, "medium"), ("embedding_model", "upgrade_embedding_model", "e5-large", "high"), ("embedding_model", "upgrade_embedding_model", "mpnet", "high"), ("unknown", *other), ("unknown", *other),
    ]


def test_readiness_of_embeddings(spark):
    nan = float("nan")
    x = spark.createDataFrame([([3.0, 4.0], False), ([3.0, 4.0], None), ([0.0, 0.0], False), (None, True), ([1.0, nan], False), ([5.0], False)], "e array<double>, fb boolean")
    r = V.readiness(x, "e", 2, "fb", requests=10, errors=1).first()
    assert (r.attempted, r.produced, r.mismatched, r.substitutes, r.outliers) == (6, 5, 1, 1, 0)
    vqs = round(100 * (0.4 * 4 / 6 + 0.3 * 4 / 6 + 0.3), 2)
    health = 100 * (0.3 * 0.9 + 0.25 * 5 / 6 + 0.2 * 5 / 6 + 0.15 + 0.1)
    assert (r.dimension_consistency, r.success_rate, r.vector_quality, r.model_health) == (83.33, 83.33, vqs, round(health, 2))
    assert r.semantic_readiness == round(0.25 * 250 / 3 + 0.35 * vqs + 0.25 * health + 0.15 * 250 / 3, 2)
    empty = V.readiness(x.limit(0), "e", 2).first()
    assert (empty.attempted, empty.dimension_consistency, empty.success_rate, empty.vector_quality) == (0, 0.0, 0.0, 30.0)
    assert V.readiness(x, "e", 2, fallback_mode=True).first().model_health == 0.0
