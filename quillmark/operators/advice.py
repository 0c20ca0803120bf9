"""Ordered rule tables: the first rule of each group that holds decides for it, and what the groups decided is put together."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Act:
    """One action: its settings as SQL expressions, its priority, and the condition under which its rule asks for it."""

    action: str
    config: tuple[tuple[str, str], ...]
    priority: str | None = None
    when: str = "true"


@dataclass(frozen=True)
class Rule:
    """A band of a group: where it holds, what it asks for, flags to set, and playbooks to name or to switch to."""

    group: str
    band: str
    when: str
    acts: tuple[Act, ...] = ()
    tweaks: tuple[str, ...] = ()
    name_playbook: tuple[str, str] | None = None
    next_playbook: tuple[str, str] | None = None


_NOT_TECH = "coalesce(upper(playbook), '') <> 'TECH'"
_TO_SCANNED = "playbook IS NULL OR upper(playbook) = 'REGULATORY'"
_CLEAN = (("enable_advanced_cleaning", "true"), ("error_correction", "true"))
_FIX = (("enable_error_correction", "true"),)
_ALL = (("enhance_normalization", "true"), ("error_correction", "true"))
_OVERLAP = (("increase_by_percent", "25"), ("min_overlap", "200"))
_TECH = Act("switch_playbook", (("playbook_id", "'TECH'"),), when=_NOT_TECH)

#: Fixed bands, bounds and settings of the advice, in order. Security's first band asks for a violation without its bound, which the policy never gives.
ADVICE = (
    Rule("trust", "below_threshold", "ai_trust < min_trust", (Act("enhance_normalization", _CLEAN, "high", "quality < 0.7"), Act("increase_chunk_overlap", _OVERLAP, "high", "completeness < 0.75"))),
    Rule("trust", "acceptable", "ai_trust < 0.7", (Act("apply_all_quality_improvements", (*_ALL, ("increase_overlap", "true")), "medium"),)),
    Rule("trust", "good", "ai_trust < 0.85", (Act("apply_all_quality_improvements", (*_ALL, ("extract_metadata", "true")), "high"),)),
    Rule("security", "below_threshold", "array_contains(violations, 'security_not_full')", tweaks=("redaction_strict",)),
    Rule("security", "good", "secure < 0.95"),
    Rule("security", "excellent", "secure < 1.0"),
    Rule("metadata", "below_threshold", "metadata_completeness < min_metadata", (Act("extract_metadata", (("force_extraction", "true"), ("additional_fields", "true"))),), ("force_metadata_extraction",)),
    Rule("metadata", "acceptable", "metadata_completeness < 0.85", (Act("extract_metadata", (("additional_fields", "true"),)),)),
    Rule("metadata", "good", "metadata_completeness < 0.9"),
    Rule("kb", "below_threshold", "kb_ready < min_kb", (_TECH,), name_playbook=("TECH", _NOT_TECH)),
    Rule("kb", "improvable", "kb_ready < 0.7", (_TECH,), name_playbook=("TECH", _NOT_TECH)),
    Rule("kb", "good", "kb_ready < 0.85"),
    Rule(
        "completeness", "low", "completeness < 0.6", (Act("switch_playbook", (("playbook_id", "'SCANNED'"),), when=_TO_SCANNED), Act("increase_chunk_overlap", _OVERLAP)),
        ("increase_chunk_overlap",), ("SCANNED", _TO_SCANNED), ("SCANNED", _TO_SCANNED),
    ),
    Rule("completeness", "acceptable", "completeness < 0.75", (Act("increase_chunk_overlap", (("increase_by_percent", "20"), ("min_overlap", "200"))),), ("increase_chunk_overlap",)),
    Rule("completeness", "good", "completeness < 0.9"),
    Rule("quality", "low", "quality < 0.7", (Act("enhance_normalization", _CLEAN, "high"), Act("error_correction", _FIX, "high"))),
    Rule("quality", "good", "quality < 0.85", (Act("enhance_normalization", _CLEAN, "medium"), Act("error_correction", _FIX, "medium"))),
    Rule("policy", "failed", "size(violations) > 0"),
    Rule("policy", "passed_below_0.8", "ai_trust < 0.8", (Act("apply_all_quality_improvements", (*_ALL, ("extract_metadata", "true"), ("increase_overlap", "completeness < 0.8")), "high"),)),
    Rule("policy", "passed_below_0.85", "ai_trust < 0.85", (Act("apply_all_quality_improvements", (*_ALL, ("extract_metadata", "true")), "high"),)),
)
METRICS = ("ai_trust", "secure", "metadata_completeness", "kb_ready", "completeness", "quality")
BOUNDS = {"min_trust": 0.5, "min_secure": 0.9, "min_metadata": 0.8, "min_kb": 0.5}
_ACT = "struct<action:string,config:map<string,string>,priority:string>"


def _act(a: Act) -> Column:
    made = F.create_map(*[x for k, v in a.config for x in (F.lit(k), F.expr(v).cast("string"))])
    return F.when(F.expr(a.when), F.struct(F.lit(a.action).alias("action"), made.alias("config"), F.lit(a.priority).cast("string").alias("priority")))


def _decision(r: Rule) -> Column:
    name = lambda p: F.when(F.expr(p[1]), p[0]) if p else F.lit(None).cast("string")
    return F.struct(
        F.lit(f"{r.group}:{r.band}").alias("band"),
        (F.array_compact(F.array(*[_act(a) for a in r.acts])) if r.acts else F.array().cast(f"array<{_ACT}>")).alias("acts"),
        F.array(*[F.lit(t) for t in r.tweaks]).cast("array<string>").alias("tweaks"),
        name(r.name_playbook).alias("named"),
        name(r.next_playbook).alias("next"),
    )


def decide(x: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """x with `decisions`: for each group, in the order of its first rule, what its first rule that holds asks for; groups without one are left out. A condition that is null doesn't hold."""
    groups: dict[str, list[Rule]] = {}
    for r in rules:
        groups.setdefault(r.group, []).append(r)
    first = [reduce(lambda c, r: c.when(F.expr(r.when), _decision(r)), g[1:], F.when(F.expr(g[0].when), _decision(g[0]))) for g in groups.values()]
    return x.withColumn("decisions", F.array_compact(F.array(*first)))


def advise(fingerprints: DataFrame, rules: tuple[Rule, ...] = ADVICE, bounds: dict[str, float] | None = None) -> DataFrame:
    """fingerprints (the six METRICS and playbook) with bands, actions, tweaks, playbooks and next_playbook.

    bands: group:band of every group that has something to say; `general:within_ranges` if none has. actions: struct(action, config, priority) in the order of the groups. playbooks: those named, and
    once more the one to switch to. next_playbook: the present one if nothing asks for another. A metric that is null or missing counts as 0, as in the policy; a null playbook is none.
    Columns of these names and of BOUNDS are replaced. One row in, one row out, without a shuffle.
    """
    x = fingerprints
    for m in METRICS:
        x = x.withColumn(m, F.coalesce(F.col(m).cast("double"), F.lit(0.0)) if m in x.columns else F.lit(0.0))
    limits = BOUNDS | (bounds or {})
    x = x.withColumns({k: F.lit(v) for k, v in limits.items()})
    policy = (("ai_trust", "min_trust", "low_trust"), ("secure", "min_secure", "security_not_full"), ("metadata_completeness", "min_metadata", "weak_metadata"), ("kb_ready", "min_kb", "kb_not_ready"))
    x = x.withColumn("violations", F.array_compact(F.array(*[F.when(F.col(m) < F.col(b), f"{n}(<{limits[b]})") for m, b, n in policy])))
    x = decide(x, rules)
    named = F.array_compact(F.transform("decisions", lambda d: d["named"]))
    asked = F.array_compact(F.transform("decisions", lambda d: d["next"]))
    after = F.coalesce(F.get(asked, F.size(asked) - 1), F.col("playbook"))
    x = x.withColumn("bands", F.transform("decisions", lambda d: d["band"])).withColumn("actions", F.flatten(F.transform("decisions", lambda d: d["acts"])))
    x = x.withColumn("tweaks", F.array_distinct(F.flatten(F.transform("decisions", lambda d: d["tweaks"])))).withColumn("next_playbook", after)
    moved = F.col("next_playbook").isNotNull() & ~F.col("next_playbook").eqNullSafe(F.col("playbook"))
    x = x.withColumn("playbooks", F.concat(named, F.when(moved, F.array("next_playbook")).otherwise(F.array().cast("array<string>"))))
    quiet = (F.size("bands") == 0) & (F.size("playbooks") == 0)
    return x.withColumn("bands", F.when(quiet, F.array(F.lit("general:within_ranges"))).otherwise(F.col("bands"))).drop("decisions", *BOUNDS)


def apply_actions(actions: Column, chunk_size: Column, chunk_overlap: Column, playbook: Column) -> Column:
    """Settings after all actions, taken in order: struct(chunk_overlap, playbook, enhanced_normalization, error_correction, extract_metadata, force_metadata, additional_fields).

    A larger overlap is the old one by its per cent, its least value at least, and 0.9 of the size at most; taken with all improvements it grows by a quarter, to 400 at most.
    Unknown actions change nothing; a null array is no action.
    """
    flags = ("enhanced_normalization", "error_correction", "extract_metadata", "force_metadata", "additional_fields")
    start = F.struct(chunk_overlap.cast("int").alias("chunk_overlap"), playbook.cast("string").alias("playbook"), *[F.lit(False).alias(f) for f in flags])

    def step(s: Column, a: Column) -> Column:
        said = lambda k, d: F.coalesce(F.try_element_at(a["config"], F.lit(k)), F.lit(d))
        every = a["action"] == "apply_all_quality_improvements"
        old = s["chunk_overlap"]
        grown = F.greatest(said("min_overlap", "200").cast("int"), (old * (1 + said("increase_by_percent", "20").cast("double") / 100)).cast("int"))
        overlap = F.when(a["action"] == "increase_chunk_overlap", F.least(grown, (chunk_size * F.lit(0.9)).cast("int")))
        overlap = overlap.when(every & (said("increase_overlap", "false") == "true"), F.least((old * F.lit(1.25)).cast("int"), F.lit(400))).otherwise(old)
        meta = a["action"] == "extract_metadata"
        new = {
            "enhanced_normalization": F.when(every | (a["action"] == "enhance_normalization"), True),
            "error_correction": F.when(every | (a["action"] == "error_correction"), True).when(a["action"] == "enhance_normalization", said("error_correction", "true") == "true"),
            "extract_metadata": F.when(every | meta, True),
            "force_metadata": F.when(meta, said("force_extraction", "true") == "true"),
            "additional_fields": F.when(meta, said("additional_fields", "true") == "true"),
        }
        book = F.when(a["action"] == "switch_playbook", F.coalesce(F.try_element_at(a["config"], F.lit("playbook_id")), s["playbook"])).otherwise(s["playbook"])
        return F.struct(overlap.alias("chunk_overlap"), book.alias("playbook"), *[F.coalesce(new[f], s[f]).alias(f) for f in flags])

    return F.aggregate(F.coalesce(actions, F.array().cast(f"array<{_ACT}>")), start, step)


#: Fixed causes of a failed metric, by what the details of its evaluation say; the first that holds.
CAUSES = (
    Rule("groundedness", "chunk_boundaries", "metric = 'groundedness' AND coalesce(unsupported_claims, 0) > coalesce(supported_claims, 0)"),
    Rule("groundedness", "chunk_overlap", "metric = 'groundedness' AND citation_issues"),
    Rule("groundedness", "retrieval_quality", "metric = 'groundedness'"),
    Rule("citation", "citation_format", "metric = 'citation_coverage' AND invalid_citations > 0"),
    Rule("citation", "chunk_boundaries", "metric = 'citation_coverage'"),
    Rule("refusal", "acl_config", "metric = 'refusal_correctness' AND acl_denied"),
    Rule("refusal", "prompt_template", "metric = 'refusal_correctness'"),
    Rule("relevance", "embedding_model", "metric IN ('context_relevance', 'answer_relevance')"),
)


def diagnose(failures: DataFrame) -> DataFrame:
    """failures (metric, unsupported_claims, supported_claims, citation_issues, invalid_citations, acl_denied, chunk_size, chunk_overlap, embedder) with cause, action, setting, value and priority.

    Null counts are 0 and null flags false; a null or other metric has the cause `unknown`. Null settings take their defaults: a size of 1000, an overlap of 200, the embedder minilm. value is text, null
    where the action changes no setting.
    """
    x = decide(failures, CAUSES)
    x = x.withColumn("cause", F.coalesce(F.substring_index(F.get(F.col("decisions.band"), 0), ":", -1), F.lit("unknown"))).drop("decisions")
    size, overlap, model = F.coalesce("chunk_size", F.lit(1000)), F.coalesce("chunk_overlap", F.lit(200)), F.coalesce("embedder", F.lit("minilm"))
    pick = lambda a, s, v, p: F.struct(F.lit(a).alias("action"), F.lit(s).cast("string").alias("setting"), v.cast("string").alias("value"), F.lit(p).alias("priority"))
    none = F.lit(None)
    remedy = (
        F.when(F.col("cause") == "chunk_overlap", pick("increase_chunk_overlap", "chunk_overlap", F.least(overlap + 100, F.lit(500)), "high"))
        .when(F.col("cause") == "chunk_boundaries", pick("increase_chunk_size", "chunk_size", F.least(size + 200, F.lit(2000)), "medium"))
        .when(F.col("cause") == "embedding_model", pick("upgrade_embedding_model", "embedder_name", F.when(model == "minilm", "mpnet").otherwise("e5-large"), "high"))
        .when(F.col("cause") == "acl_config", pick("review_acl_config", None, none, "high"))
        .when(F.col("cause") == "prompt_template", pick("update_prompt_template", None, none, "medium"))
        .otherwise(pick("review_pipeline", None, none, "low"))
    )
    return x.withColumn("_r", remedy).select(*failures.columns, "cause", "_r.*")
