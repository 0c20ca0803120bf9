"""Chunk metrics in [0, 1] and the weighted trust score, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SENTENCE_CUT, EMAIL, PHONE, clip, has_pii, let, n_words, sentences, stripped, token_estimate, words

#: Fixed weights of the trust score; they sum to 1.
WEIGHTS = {
    "completeness": 0.10, "validity": 0.08, "consistency": 0.08, "uniqueness": 0.08, "timeliness": 0.05, "text_integrity": 0.10,
    "parse_success": 0.05, "chunk_boundary_quality": 0.05, "chunk_coherence": 0.10, "chunk_size_health": 0.08,
    "metadata_completeness": 0.10, "provenance_coverage": 0.13,
}
#: Fixed windows of healthy chunk sizes: least and most that is fair, least and most that is best.
SIZES = {"regulated": (500, 900, 600, 800), "general": (600, 1200, 800, 1100)}
REGULATED = ("regulatory", "reg", "legal", "finance_banking")
#: Fixed phrases that show connected writing; the sixth counts twice.
CONNECTIVES = (
    "because", "therefore", "however", "although", "in addition", "furthermore", "specifically", "for example", "such as", "including",
    "namely", "in particular", "according to", "based on", "related to", "associated with", "compared to", "as a result", "consequently", "meanwhile", "moreover",
)
#: Fixed words that show who is addressed, with each group's points per word.
AUDIENCES = (
    (("hcp", "physician", "patient", "doctor", "nurse", "clinician", "prescriber", "caregiver", "healthcare"), 0.25),
    (("executive", "management", "stakeholder", "board", "investor", "shareholder", "revenue", "profit", "quarterly", "annual"), 0.15),
    (("developer", "engineer", "api", "sdk", "cli", "code", "implementation", "integration", "deployment", "architecture", "technical"), 0.15),
    (("operations", "monitoring", "maintenance", "support", "service", "infrastructure", "scalability", "performance"), 0.15),
    (("attorney", "lawyer", "counsel", "legal counsel", "compliance", "legal requirement", "legal framework", "jurisdiction", "litigation",
      "contract", "agreement", "legal entity", "legal obligation"), 0.20),
)
#: Fixed words of a domain, with points per word.
DOMAINS = {
    "regulatory": ((
        "supervisor", "auditor", "regulator", "supervision", "regulatory", "compliance officer", "risk manager", "internal audit",
        "regulatory authority", "supervisory authority", "audit committee", "compliance framework", "regulatory requirement",
        "supervisory review", "regulatory reporting", "audit trail", "regulatory compliance", "compliance", "supervisory", "audit"), 0.20),
    "finance_banking": ((
        "bank", "banking", "financial institution", "lender", "borrower", "credit risk", "market risk", "liquidity risk", "operational risk",
        "capital adequacy", "solvency", "balance sheet", "income statement", "financial statement", "audit", "auditor", "compliance officer",
        "risk manager", "treasurer", "cfo", "financial analyst", "investor", "shareholder", "stakeholder", "regulatory reporting", "financial"), 0.18),
}
KNOWN_AUDIENCES = ("hcp", "executive", "regulatory", "patient", "finance", "ops", "dev")


def rounded(c: Column, places: int = 4) -> Column:
    """Ties go up, and so do values within 1e-9 of one: sums that are equal but for the order of their terms get the same digits."""
    return F.round(c + 1e-9, places)


def present(*cols: Column) -> Column:
    """Share of the columns that are neither null nor empty."""
    return sum((F.coalesce(c.cast("string") != "", F.lit(False)).cast("int") for c in cols), F.lit(0)) / F.lit(float(len(cols)))


def completeness(text: Column, w: Column | None = None) -> Column:
    """w, and s and n below: words, sentences and stripped length, where a query has them as columns already."""
    return F.when((n_words(text) if w is None else w) > 1000, 1.0).otherwise(0.75)


def playbook_completeness(sections: Column, fields: Column, required_sections: list[str], required_fields: list[str]) -> Column:
    """0.6 of the share of required sections, 0.4 of that of required fields."""
    share = lambda have, need: F.size(F.array_intersect(have, F.array(*map(F.lit, need)))) / float(len(need)) if need else F.lit(1.0)
    return share(sections, required_sections) * 0.6 + share(fields, required_fields) * 0.4


def rules_passed(rules: list[dict], col=F.col) -> Column:  # noqa: ANN001
    """Share of validity rules that pass: pattern_match and required are tested, other kinds pass."""
    if not rules:
        return F.lit(1.0)
    ok = []
    for r in rules:
        c = F.coalesce(col(r["field"]).cast("string"), F.lit("")) if r.get("field") else F.lit("")
        ok.append(F.rlike(c, F.lit("(?i)" + r["pattern"])) if r.get("type") == "pattern_match" else c != "" if r.get("type") == "required" else F.lit(True))
    return sum((o.cast("int") for o in ok), F.lit(0)) / float(len(ok))


def rules_consistent(rules: list[dict], col=F.col) -> Column:  # noqa: ANN001
    """Passed weight by severity over all weight: value_match and range_check are tested, other kinds pass."""
    if not rules:
        return F.lit(1.0)
    weight = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2}
    total, got = 0.0, F.lit(0.0)
    for r in rules:
        w = weight.get(str(r.get("severity", "medium")).lower(), 0.5)
        total += w
        if r.get("type") == "value_match":
            ok = F.coalesce(col(r["field"]).cast("string") == F.lit(r.get("expected")), F.lit(False))
        elif r.get("type") == "range_check":
            v = col(r["field"]).cast("string").try_cast("double")
            ok = F.coalesce(v.isNotNull() & (v >= F.lit(float(r.get("min", float("-inf"))))) & (v <= F.lit(float(r.get("max", float("inf"))))), F.lit(False))
        else:
            ok = F.lit(True)
        got = got + F.when(ok, w).otherwise(0.0)
    return got / total


def integrity(repetition: Column, noise: Column, spelling: Column | None = None) -> Column:
    """0.6 of what cleanup figures say, where there are any, and 0.4 of the spelling's score, else that alone; the spelling counts as 0.85 if it isn't measured."""
    s = F.lit(0.85) if spelling is None else spelling
    return F.when(repetition.isNull() | noise.isNull(), s).otherwise(clip(noise * (1 - repetition * 0.5)) * 0.6 + s * 0.4)


def timeliness(stamp: Column, as_of: Column, sla_hours: float = 8760.0) -> Column:
    """1 for today, 0 at the limit; 0.5 without a date or for one to come. Whole days, from the date part."""
    day = F.try_to_timestamp(F.split(stamp.cast("string"), "[T ]")[0], F.lit("yyyy-MM-dd")).cast("date")
    hours = F.datediff(as_of.cast("date"), day) * 24.0
    return F.when(day.isNull() | (hours < 0), 0.5).otherwise(clip(1 - hours / sla_hours))


def parse_success(text: Column, least: int = 50, n: Column | None = None) -> Column:
    return F.when((F.length(stripped(text)) if n is None else n) >= least, 1.0).otherwise(0.0)


def size_health(tokens: Column, domain: Column | None = None) -> Column:
    """Best inside a window by domain, falling off on both sides."""

    def by(fair_low: int, fair_high: int, low: int, high: int) -> Column:
        return (
            F.when(tokens.between(low, high), 1.0)
            .when((tokens >= fair_low) & (tokens < low), 0.7 + (tokens - fair_low) / (low - fair_low) * 0.3)
            .when((tokens > high) & (tokens <= fair_high), 0.7 + (fair_high - tokens) / (fair_high - high) * 0.3)
            .when(tokens < fair_low, F.greatest(F.lit(0.0), tokens / fair_low * 0.7))
            .otherwise(F.greatest(F.lit(0.0), 0.7 * (1 - F.least(F.lit(1.0), (tokens - fair_high) / fair_high))))
        )

    general = by(*SIZES["general"])
    return general if domain is None else F.when(F.lower(domain).isin(*REGULATED), by(*SIZES["regulated"])).otherwise(general)


def provenance(checksum: Column, run: Column, model: Column, model_version: Column, stamp: Column, extracted: Column) -> Column:
    """Weighted checklist of where a chunk came from."""
    out = F.lit(0.0)
    for c, w in ((checksum, 0.25), (run, 0.20), (model, 0.15), (model_version, 0.15), (stamp, 0.15), (extracted, 0.10)):
        out = out + F.when(F.coalesce(c.cast("string") != "", F.lit(False)), w).otherwise(0.0)
    return out


def secure(text: Column) -> Column:
    return F.when(has_pii(text), 0.0).otherwise(1.0)


def sentence_length(text: Column) -> Column:
    """Words per sentence; null without a sentence."""
    n = F.size(sentences(text))
    return F.when(n > 0, n_words(text) / n)


def quality(text: Column, w: Column | None = None, s: Column | None = None, n: Column | None = None) -> Column:
    """A step function of the mean sentence length."""
    w = n_words(text) if w is None else w
    s = sentence_length(text) if s is None else F.when(s > 0, w / s)
    return (
        F.when((F.length(stripped(text)) if n is None else n) < 50, 0.40).when(w < 20, 0.55).when(s.isNull(), 0.60).when(s < 5, 0.60).when(s < 10, 0.70)
        .when(s <= 25, 0.85).when(s <= 35, 0.80).when(s <= 45, 0.70).when(s <= 60, 0.60).otherwise(0.50)
    )


def context_quality(text: Column) -> Column:
    """Structure, figures, dates, references, connectives, names and length on a base of 0.40."""
    low, w = F.lower(text), n_words(text)
    has = lambda c, p, v: F.when(F.rlike(c, F.lit(p)), v).otherwise(0.0)
    hits = sum((F.contains(low, F.lit(p)).cast("int") for p in (*CONNECTIVES, "furthermore")), F.lit(0))
    s = F.lit(0.40) + F.when(F.contains(text, F.lit("\n\n")) | (F.regexp_count(text, F.lit("\n")) > 3), 0.20).otherwise(0.0)
    s = s + F.when(F.rlike(text, F.lit(r"(?:^|\n)[\s]*[•\-\*\+]\s")) | F.rlike(text, F.lit(r"(?:^|\n)[\s]*\d+[\.\)]\s")), 0.15).otherwise(0.0)
    s = s + has(text, r"\b\d+(?:[.,]\d+)?(?:%|\$|USD|EUR|million|billion)?\b", 0.15)
    s = s + has(low, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}\b", 0.10)
    s = s + has(low, r"\b(?:see|refer|reference|section|chapter|page|table|figure)\s+[\d]+", 0.10)
    s = s + F.least(hits * 0.02, F.lit(0.15)) + has(text, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", 0.10)
    s = s + F.when(w > 100, F.least((w - 100) / 2000.0, F.lit(0.10))).otherwise(0.0)
    return F.when(F.length(stripped(text)) < 50, 0.30).otherwise(F.least(s, F.lit(1.0)))


def metadata_presence(source: Column, section: Column, audience: Column, stamp: Column, field: Column, document: Column) -> Column:
    """Share of four fields and 0.10 for each of four that say something."""
    s = present(source, section, audience, stamp)
    for c, empty in ((section, ("", "general", "unknown", "none")), (field, ("", "general", "unknown", "none")), (audience, ("", "unknown", "general")), (document, ("",))):
        s = s + F.when(~F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))).isin(*empty), 0.10).otherwise(0.0)
    return F.least(s, F.lit(1.0))


def _hits(low: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms occur as whole words; a plain search comes first, as most don't occur at all."""
    return sum(((F.contains(low, F.lit(t)) & F.rlike(low, F.lit(rf"\b{t}\b"))).cast("int") for t in terms), F.lit(0))


def audience_intent(text: Column, domain: str | None = None) -> Column:
    """Words that address readers: a domain's own words first, which halve the general ones' points."""
    return F.get(audience_intents(text, (domain,)), F.lit(0))


def audience_intents(text: Column, domains: tuple[str | None, ...]) -> Column:
    """`audience_intent` for several domains, as an array. The text is put in lower case once, and what all domains have in common is looked for once."""

    def of(low: Column) -> Column:
        general = sum((F.least(_hits(low, terms) * points, F.lit(0.50)) for terms, points in AUDIENCES), F.lit(0.0))
        direct = F.when(F.rlike(low, F.lit(r"\b(?:you|your|users?|customers?|readers?|audience)\b")), 0.30).otherwise(0.0)
        meant = F.when(F.rlike(low, F.lit(r"\b(?:for|intended\s+for|designed\s+for|targeted\s+to)\s+(?:the\s+)?\w+")), 0.20).otherwise(0.0)

        def one(x: Column, domain: str | None) -> Column:
            whole = lambda s: F.least(s + x["direct"] + x["meant"], F.lit(1.0))
            if domain not in DOMAINS:
                return whole(x["general"])
            terms, points = DOMAINS[domain]
            return let(_hits(low, terms), lambda n: whole(F.least(n * points, F.lit(0.60)) + x["general"] * F.when(n > 0, 0.5).otherwise(1.0)))

        return let(F.struct(general.cast("double").alias("general"), direct.alias("direct"), meant.alias("meant")), lambda x: F.array(*[one(x, d) for d in domains]))

    return F.when(F.length(stripped(text)) < 20, F.array(*[F.lit(0.0) for _ in domains])).otherwise(let(F.lower(text), of))


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z0-9]+\b"), F.lit(0))


def diversity(text: Column, share: Column | None = None, n: Column | None = None) -> Column:
    """Distinct over all words of a-z and 0-9, null without any: 0.3 gives 0.5, 0.7 gives 1."""
    w = plain_words(text)
    r = F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)) if share is None else share
    scaled = F.when(r < 0.3, r / 0.3 * 0.5).when(r <= 0.7, 0.5 + (r - 0.3) / 0.4 * 0.5).otherwise(1.0)
    return F.when(((F.length(stripped(text)) if n is None else n) < 20) | r.isNull(), 0.0).otherwise(scaled)


def accessibility(text: Column, audience: Column) -> Column:
    """A base by audience, and a bonus for sentences of readable length."""
    a, s = F.lower(F.trim(F.coalesce(audience, F.lit("")))), sentence_length(text)
    bonus = F.when(s.between(10, 20), 0.15).when(s.between(8, 25), 0.10).when(s.between(5, 30), 0.05).otherwise(0.0)
    known = F.least(F.when(a.isin(*KNOWN_AUDIENCES), 0.85).otherwise(0.70) + bonus, F.lit(1.0))
    plain = F.rlike(F.lower(text), F.lit(r"\b(?:simple|easy|clear|straightforward|basic)\b|\b(?:example|for instance|such as|including)\b"))
    return F.when(~a.isin("", "unknown", "general"), known).when(plain, 0.50).otherwise(0.30)


def gpt_confidence() -> Column:
    """Fixed, as no model is asked."""
    return F.lit(0.85)


def kb_ready(text: Column, w: Column | None = None) -> Column:
    return F.when(((n_words(text) if w is None else w) > 50) & F.contains(text, F.lit("\n")), 1.0).otherwise(0.50)


def letters_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}", "")) / F.greatest(F.length(text), F.lit(1))


def ascii_share(text: Column, probe: int = 1000) -> Column:
    head = F.substring(text, 1, probe)
    return F.when(F.length(head) == 0, 1.0).otherwise(F.length(F.regexp_replace(head, r"[^\x00-\x7F]", "")) / F.length(head))


def trust(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The weighted sum; weights are scaled to 1 if they miss it by over 0.01, and a missing score counts 0."""
    w = dict(weights or WEIGHTS)
    total = sum(w.values())
    if abs(total - 1) > 0.01:
        w = {k: v / total for k, v in w.items()}
    return rounded(sum((clip(scores[k]) * v for k, v in w.items() if k in scores), F.lit(0.0)))


def connectivity(text: Column) -> Column:
    """Mean word overlap (Jaccard) of neighbouring sentences; 0 under 50 characters, 1 with one sentence."""
    cut = F.filter(F.transform(F.split(text, r"[.!?]+(?=\s+[A-Z0-9\"'(\[{]|$)"), stripped), lambda s: s != "")
    sets = F.transform(cut, lambda s: F.array_distinct(words(F.lower(s))))
    empty = F.struct(F.lit(None).cast("array<string>").alias("p"), F.lit(0.0).alias("t"))
    both = lambda a, x: let(F.size(F.array_intersect(a["p"], x)), lambda c: c / (F.size(a["p"]) + F.size(x) - c))

    def mean(every: Column) -> Column:
        total = F.aggregate(every, empty, lambda a, x: F.struct(x.alias("p"), (a["t"] + F.coalesce(both(a, x), F.lit(0.0))).alias("t")), lambda a: a["t"])
        return F.when(F.size(every) < 2, 1.0).otherwise(total / (F.size(every) - 1))

    return F.when(F.length(stripped(text)) < 50, 0.0).otherwise(let(sets, mean))


#: Fixed default patterns of noise: boilerplate, navigation, legal footers. They start on different words, so they don't overlap.
NOISE = {
    "boilerplate": (r"(?im)^\s*(?:confidential|proprietary|copyright|all rights reserved)", r"(?im)^\s*page\s+\d+\s+of\s+\d+\s*$"),
    "navigation": (r"(?im)^\s*(?:table of contents|index|appendix)\s*$",),
    "legal_footer": (r"(?im)^\s*(?:this document is confidential|not for distribution)",),
}


def noise_chars(text: Column, kind: str) -> Column:
    """Characters in matches of one kind of noise."""
    per = [F.aggregate(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.lit(0), lambda a, m: a + F.length(m)) for p in NOISE[kind]]
    return sum(per[1:], per[0])


def noise_free(text: Column) -> Column:
    """1 less the share of characters in noise."""
    return clip(1 - sum((noise_chars(text, k) for k in NOISE), F.lit(0)) / F.greatest(F.length(text), F.lit(1)))


def fallback(text: Column, section: Column, field: Column, document: Column, audience: Column) -> dict[str, Column]:
    """The simpler scorer's metrics, for chunks that are less than half letters."""
    t = stripped(text)
    cut = F.filter(F.transform(F.split(t, SENTENCE_CUT), stripped), lambda s: s != "")
    mean = let(cut, lambda cut: F.when(F.size(cut) == 0, n_words(t).cast("double")).otherwise(F.aggregate(cut, F.lit(0), lambda a, s: a + n_words(s)) / F.greatest(F.size(cut), F.lit(1))))
    q = let(mean, lambda mean: F.when(mean <= 0, 0.0).when(mean < 10, mean / 10).when(mean > 30, F.greatest(F.lit(0.0), 1 - (mean - 30) / 30)).otherwise(1.0))
    sec = F.lower(F.trim(F.coalesce(section, F.lit(""))))
    context = F.when((sec != "") & F.contains(F.lower(t), sec), 1.0).otherwise(0.5)
    meta = F.when(present(section, field, document) == 1, 1.0).otherwise(0.5)
    w = F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0))
    return {
        "text_integrity": ascii_share(t), "timeliness": F.lit(0.5), "parse_success": parse_success(t), "Secure": F.when(F.rlike(t, F.lit(EMAIL)) | F.rlike(t, F.lit(PHONE)), 0.75).otherwise(1.0),
        "Quality": q, "Context_Quality": context, "Metadata_Presence": meta,
        "Audience_Intentionality": F.when(F.lower(F.coalesce(audience, F.lit("unknown"))).isin("", "unknown"), 0.25).otherwise(1.0),
        "Diversity": let(w, lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)))),
        "Audience_Accessibility": let(mean, lambda mean: F.when(mean.between(10, 25), 1.0).when(mean > 0, F.greatest(F.lit(0.0), 1 - F.least(F.abs(mean - 17.5) / 25, F.lit(1.0)))).otherwise(0.0)),
        "KnowledgeBase_Ready": clip(meta * 0.4 + q * 0.4 + context * 0.2), "token_est": token_estimate(t).cast("double"),
    }
