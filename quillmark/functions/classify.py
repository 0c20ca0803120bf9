"""Labels for texts: audience, playbook, kind of content with a chunking setup."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .text import let

#: Fixed patterns of audiences; the first of equal counts wins.
AUDIENCES = {
    "hcp": r"\b(hcp|physician|prescriber|clinical|doctor|nurse|clinician|healthcare provider)\b",
    "executive": r"\b(executive|vp|vice president|steerco|cxo|ceo|cto|cfo|board|director|leadership|management)\b",
    "patient": r"\b(patient|caregiver|consumer|user)\b",
    "regulatory": r"\b(regulatory|compliance|sop|policy|regulation|fda|ema|regulatory authority)\b",
    "finance": r"\b(p&l|profit.*loss|variance|forecast|budget|kpi|quarter|quarterly|financial|revenue|earnings|income statement)\b",
    "ops": r"\b(monitoring|deployment|incident|runbook|oncall|slo|sla|kubernetes|cluster|operations|infrastructure)\b",
    "dev": r"\b(api|cli|sdk|endpoint|json|yaml|code|pipeline|ci/cd|developer|engineer|programmer)\b",
    "general": r"\b(overview|introduction|getting started|guide|tutorial|documentation|help|support)\b",
}
#: Fixed words and phrases that route a text to a playbook.
MEDICAL_WORDS = (
    "diabetes", "diabetic", "medical", "medicine", "clinical", "patient", "patients", "treatment", "therapy", "diagnosis", "disease", "diseases", "symptom", "symptoms",
    "health", "healthcare", "hospital", "physician", "doctor", "medication", "drug", "drugs", "pharmaceutical", "pharma", "trial", "trials", "study", "studies", "research",
    "researchers", "type 1", "type 2", "insulin", "glucose", "blood sugar", "hba1c", "metabolic", "pathology", "pathological", "epidemiology", "epidemiological", "prevalence",
    "incidence", "mortality", "morbidity", "comorbidity", "comorbidities", "syndrome", "disorder", "condition", "conditions",
)
MEDICAL_PHRASES = (
    "type 1 diabetes", "type 2 diabetes", "type i diabetes", "type ii diabetes", "clinical trial", "randomized controlled", "case study", "cohort study", "patient population",
    "treatment group", "control group", "placebo",
)
BANKING_WORDS = (
    "banking", "financial", "finance", "bank", "liquidity", "solvency", "credit risk", "market risk", "balance sheet", "income statement", "interest rate", "basel", "crd", "crr",
    "eba", "ecb", "ssm", "supervision", "auditor", "supervisor", "capital adequacy", "regulatory capital", "tier 1", "tier 2", "risk-weighted assets",
)
BANKING_PHRASES = ("balance sheet", "income statement", "cash flow", "financial statement", "regulatory capital", "capital adequacy", "risk-weighted")
REGULATORY_WORDS = ("label", "regulatory", "prescribing information", "safety", "fda", "ema", "compliance", "regulation", "guidelines", "directive", "framework", "requirement")
#: Fixed patterns of the kinds of content, in their order.
KINDS = {
    "legal": (r"\b(whereas|hereby|herein|hereinafter|pursuant to|in accordance with)\b", r"\b(agreement|contract|terms|conditions|clause|section)\b", r"\b(party|parties|plaintiff|defendant|court|legal)\b"),
    "medical": (
        r"\b(who|world health organization)\b", r"\b(epidemiology|epidemiological|prevalence|incidence|morbidity|mortality)\b", r"\b(diagnosis|treatment|therapy|therapeutic|screening|complications|prevention)\b",
        r"\b(guideline|guidelines|health system|clinical\s+practice)\b", r"\b(clinical\s+trial|randomized\s+controlled|cohort\s+study|systematic\s+review|meta-?analysis)\b",
        r"\b(clinical|patient|patients|disease|symptom|symptoms|medication|pharmaceutical|drug|drugs)\b", r"\b(efficacy|safety|adverse\s+event|biomarker|etiology|prognosis|pathology|pathological)\b",
        r"\b(intervention|vaccine|vaccination|oncology|cardiology|neurology|infectious\s+disease)\b", r"\b(comorbidity|comorbidities|disorder|syndrome|diagnostic|prognostic)\b",
    ),
    "regulatory": (
        r"\b(supervisor|auditor|regulator|supervision|regulatory)\b", r"\b(eba|ecb|basel|crr|crd|ssm|pru|fca|sec)\b", r"\b(guidelines|framework|directive|regulation|compliance)\b",
        r"\b(capital|risk|governance|oversight|monitoring)\b", r"\b(principle|requirement|standard|provision)\b", r"\b(whereas|pursuant to|in accordance with|hereinafter)\b",
    ),
    "finance_banking": (
        r"\b(banking|financial|finance|bank|institution)\b", r"\b(capital|liquidity|solvency|credit|market\s+risk)\b", r"\b(asset|liability|balance\s+sheet|income\s+statement)\b",
        r"\b(regulation|compliance|audit|supervision)\b", r"\b(interest\s+rate|yield|portfolio|investment)\b",
    ),
    "code": (r"^\s*(def|class|function|import|from|if|for|while|try|except)\s+", r"^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*[=\(]", r"^\s*#.*$", r"^\s*//.*$", r"^\s*/\*.*\*/$"),
    "documentation": (r"^#{1,6}\s+", r"^\s*\*\s+", r"^\s*\d+\.\s+", r"```", r"\[.*\]\(.*\)"),
    "conversation": (r"^\s*\d{1,2}:\d{2}\s+[AP]M\s+", r"^\s*\[.*\]\s+", r"^\s*<.*>\s+", r"^\s*\w+:\s+"),
    "academic": (r"\b(abstract|introduction|methodology|results|conclusion|references)\b", r"\b(study|research|analysis|hypothesis|findings|implications)\b", r"^\s*\d+\.\d+\s+", r"\[.*\]\s*\(.*\)"),
    "technical": (r"\b(API|endpoint|request|response|authentication|authorization)\b", r"\b(database|query|table|index|schema|migration)\b", r"\b(algorithm|optimization|performance|scalability|architecture)\b", r"^\s*```\w*$"),
}
#: Fixed words of medical texts, looked for as parts of the lower-cased text.
MEDICAL_KEYWORDS = (
    "medical", "medicine", "clinical", "patient", "patients", "treatment", "therapy",
    "diagnosis", "disease", "diseases", "symptom", "symptoms", "health", "healthcare",
    "hospital", "physician", "doctor", "medication", "drug", "drugs", "pharmaceutical",
    "pharma", "trial", "trials", "study", "studies", "research", "researchers",
    "pathology", "pathological", "epidemiology", "epidemiological", "prevalence",
    "incidence", "mortality", "morbidity", "comorbidity", "comorbidities", "syndrome",
    "disorder", "condition", "conditions", "who", "screening", "complications",
    "guideline", "prevention", "health system", "efficacy", "safety", "adverse event",
    "biomarker", "etiology", "prognosis", "systematic review", "meta-analysis",
    "cohort study", "randomized", "vaccine", "vaccination", "therapeutic", "intervention",
)
#: Fixed names of diseases and treatments, looked for in the same way (so the one with a capital never occurs).
MEDICAL_SUBJECTS = (
    "diabetes", "diabetic", "insulin", "glucose", "hbA1c", "hypoglycemia", "hyperglycemia",
    "hypertension", "cardiovascular", "myocardial", "stroke", "cancer", "oncology",
    "tuberculosis", "malaria", "hiv", "hepatitis", "asthma", "copd", "chronic kidney",
    "renal", "neuropathy", "retinopathy", "nephropathy", "type 1 diabetes", "type 2 diabetes",
    "metformin", "antihypertensive", "antibiotic", "antiviral", "immunization",
    "diagnostic criteria", "differential diagnosis", "clinical presentation", "prognostic",
)
#: Fixed phrasings of clinical texts.
CLINICAL = (
    r"\bpatient(s)?\s+with\s+\w+", r"\bdiagnosed\s+with\b", r"\btreatment\s+(of|for)\s+\w+", r"\bclinical\s+(trial|study|evaluation|presentation)\b",
    r"\brandomized\s+(controlled|clinical)\b", r"\bprevalence\s+(of|rate)\b", r"\bincidence\s+(of|rate)\b", r"\bmorbidity\s+and\s+mortality\b", r"\bguidelines?\s+(for|on)\s+\w+",
    r"\bwho\s+(guidelines?|recommendations?)\b", r"\btype\s+[12]\s+diabetes\b", r"\bblood\s+(glucose|sugar|pressure)\b", r"\badverse\s+(event|effect|reaction)\b",
)
#: Fixed file endings that speak for a kind, a little.
CODE_FILES = (".py", ".js", ".java", ".cpp", ".c", ".go", ".rs", ".ts", ".rb", ".php")
TEXT_FILES = (".md", ".rst", ".txt")
#: Kinds that a playbook may hint at, and kinds from the most to the least special.
HINTS = ("regulatory", "finance_banking", "legal", "academic", "technical", "medical")
SPECIAL = ("legal", "medical", "regulatory", "finance_banking", "academic", "technical", "documentation", "conversation", "code", "general")
#: Fixed setups by kind: size, overlap, least, most (tokens), strategy.
SETUPS = {
    "legal": (1200, 240, 200, 2000, "semantic"), "medical": (800, 160, 100, 1200, "semantic"), "regulatory": (1400, 280, 200, 2200, "semantic"), "finance_banking": (1300, 260, 200, 2000, "semantic"),
    "code": (900, 180, 100, 1500, "recursive"), "documentation": (800, 160, 100, 1500, "paragraph_boundary"), "conversation": (700, 140, 50, 1200, "sentence_boundary"),
    "academic": (1200, 240, 150, 2000, "semantic"), "technical": (800, 160, 100, 1500, "semantic"), "general": (1000, 200, 100, 2000, "fixed_size"),
}


def first_best(scores: dict[str, Column], none: Column) -> Column:
    """The name of the highest positive score, the first of equals."""
    every = F.array(*[F.struct(s.cast("double").alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, (n, s) in enumerate(scores.items())])
    top = F.array_max(every)
    return F.when(top["s"] > 0, top["n"]).otherwise(none)


def audience(text: Column, section: Column, default: str = "general") -> Column:
    both = F.lower(F.concat_ws(" ", F.coalesce(section, F.lit("")), text))
    return first_best({n: F.regexp_count(both, F.lit(p)) for n, p in AUDIENCES.items()}, F.lit(default))


def with_rules(found: Column, text: Column, rules: list[dict]) -> Column:
    """The first rule {pattern, audience} that matches overrides what was found."""
    out = found
    for r in reversed(rules):
        out = F.when(F.rlike(text, F.lit("(?i)" + r["pattern"])), r["audience"]).otherwise(out)
    return out


def _times(low: Column, term: str) -> Column:
    """How often a part of a word occurs; most don't, and looking for one is cheaper than taking it out."""
    return F.when(F.contains(low, F.lit(term)), (F.length(low) - F.length(F.replace(low, F.lit(term), F.lit("")))) / len(term)).otherwise(0.0)


def route(text: Column, filename: Column) -> Column:
    """A playbook by parts of words: medical twice or a phrase, banking three times or a phrase, any regulatory word, else TECH."""
    low = F.concat_ws(" \n ", F.lower(text), F.lower(F.coalesce(filename, F.lit(""))))
    count = lambda terms: sum((_times(low, t) for t in terms), F.lit(0.0))
    has = lambda terms: F.rlike(low, F.lit("|".join(terms)))
    bank = has(BANKING_WORDS) & ((count(BANKING_WORDS) >= 3) | has(BANKING_PHRASES))
    return F.when((count(MEDICAL_WORDS) >= 2) | has(MEDICAL_PHRASES), "MEDICAL").when(bank, "FINANCIAL").when(has(REGULATORY_WORDS), "REGULATORY").otherwise("TECH")


#: What `evidence` counts: words, words also cut at stops, parts between stops, medical keywords, medical terms, matches of each kind.
EVIDENCE = ("words", "cut_words", "sentences", "keywords", "terms", *KINDS)
#: Blanks are 1 and stops are 2 among the bytes of a text.
BYTES = np.zeros(256, np.uint8)
BYTES[[32, *range(9, 14)]] = 1
BYTES[list(b".!?")] = 2


def _where(text: pa.Array, pattern: str) -> np.ndarray:
    return np.flatnonzero(pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False))


def _matches(text: pa.Array, patterns: tuple[str, ...]) -> np.ndarray:
    """How often the patterns match in each text, added up. Texts without any are found in one search."""
    n = np.zeros(len(text), np.int64)
    at = _where(text, "(?im)" + "|".join(patterns))
    some = text.take(pa.array(at))
    for p in patterns if len(at) else ():
        k = pc.count_substring_regex(some, "(?im)" + p).to_numpy().astype(np.int64)
        if p[0] == "^" and (again := np.flatnonzero(k > 1)).size:  # the count cuts off what it found, so a line would begin behind it; a replacement doesn't
            whole = some.take(pa.array(again))
            k[again] = pc.binary_length(pc.replace_substring_regex(whole, "(?im)" + p, r"\0.")).to_numpy() - pc.binary_length(whole).to_numpy()
        n[at] += k
    return n


def _said(text: pa.Array) -> dict[int, set[bytes]]:
    """The clinical phrasings of the texts that have any, by the texts' places."""
    at = _where(text, "(?i)" + "|".join(CLINICAL))
    out: dict[int, set[bytes]] = {int(i): set() for i in at}
    some = text.take(pa.array(at))
    for mark in ("\x02", "\x03") if len(at) else ():  # marks for what is found; to the patterns all control characters are alike
        some = pc.replace_substring(some, mark, "\x04")
    for p in CLINICAL if len(at) else ():
        hit = _where(some, "(?i)" + p)
        found = pc.replace_substring_regex(some.take(pa.array(hit)), "(?i)" + p, "\x02\\0\x03")
        for i, t in zip(at[hit], found.cast(pa.large_binary()).to_pylist(), strict=True):
            out[int(i)].update(m.decode()[:80].encode() for m in re.findall(rb"\x02([^\x03]*)\x03", t))
    return out


def _medical(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keywords and terms of each text."""
    low = pc.ascii_lower(text)
    for sign, letter in (("\u212a", "k"), ("\u0130", "i")):  # the two other signs with a plain letter for their lower case
        low = pc.replace_substring(low, sign, letter)
    keywords, subjects = ([w.encode() for w in words] for words in (MEDICAL_KEYWORDS, MEDICAL_SUBJECTS))
    out, said = np.zeros((2, len(text)), np.int64), _said(text)
    at = sorted({*said, *_where(low, "|".join(MEDICAL_KEYWORDS + MEDICAL_SUBJECTS)).tolist()})
    for i, t in zip(at, low.take(pa.array(at, pa.int64())).cast(pa.large_binary()).to_pylist(), strict=True):
        found = [w for w in keywords if w in t]
        out[:, i] = len(found), min(50, len({*found, *(w for w in subjects if w in t), *said.get(i, ())}))
    return out[0], out[1]


def _begun(inside: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many runs of places inside begin in each text, from the places where texts end (0 in front)."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = ends[:-1][np.diff(ends) > 0]
    first[starts] = inside[starts]
    return _per_text(first, ends)


def _per_text(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(marks[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64)


def _sizes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words also cut at stops, and parts between stops that aren't blank, of each text: runs among the bytes of all texts."""
    text = text.cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    kind = BYTES[np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends, full = ends - ends[0], kind != 1
    full_ends = np.concatenate([[0], np.cumsum(_per_text(full, ends))])
    return _begun(full, ends), _begun(kind == 0, ends), _begun(kind[full] != 2, full_ends)


@F.arrow_udf(StructType([StructField(k, IntegerType()) for k in EVIDENCE]))
def evidence(text: pa.Array) -> pa.Array:
    """struct of `EVIDENCE` of a text (null: empty). Forty patterns and a hundred words are looked for in batches, by the engine whose patterns they are (RE2), in time that grows with the text alone."""
    text, out = text.fill_null(""), [np.zeros((len(EVIDENCE), 0), np.int64)]
    for i in range(0, len(text), 256):
        part = text[i : i + 256]
        out.append([*_sizes(part), *_medical(part), *(_matches(part, p) for p in KINDS.values())])
    return pa.StructArray.from_arrays([pa.array(np.concatenate(c), pa.int32()) for c in zip(*out, strict=True)], list(EVIDENCE))


def kind_matches(text: Column, kind: str) -> Column:
    """How often the patterns of a kind match."""
    return evidence(text)[kind]


def kind_score(n: Column, words: Column) -> Column:
    """From n matches in a text of so many words: 0.6 of their log (full at 8), 0.4 of their density (full at 1.5 a thousand words), and up to 0.15 for many."""
    density = n / F.greatest(words / 1000.0, F.lit(1.0))
    s = F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log1p(F.lit(8.0))) * 0.6 + F.least(F.lit(1.0), density / 1.5) * 0.4
    s = F.when(n >= 3, F.least(F.lit(1.0), s + F.least(F.lit(0.15), (n - 3) * 0.02))).otherwise(s)
    return F.when(n > 0, s).otherwise(0.0)


def medical_evidence(text: Column) -> dict[str, Column]:
    """keywords (how many of the words occur), terms (distinct words, subjects and phrasings that occur, 50 at most), both as numbers."""
    e = evidence(text)
    return {"keywords": e["keywords"], "terms": e["terms"]}


def prior(filename: Column) -> Column:
    """struct(kind, score) that a file's ending speaks for; null for others."""
    end = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"[^./](\.[^./]*)$", 1))
    return F.when(end.isin(*CODE_FILES), F.struct(F.lit("code").alias("k"), F.lit(0.35).alias("s"))).when(end.isin(*TEXT_FILES), F.struct(F.lit("documentation").alias("k"), F.lit(0.25).alias("s")))


def detect(counts: dict[str, Column], words: Column, keywords: Column, terms: Column, file_prior: Column, hint: Column) -> Column:
    """struct(kind, confidence, gap, candidates, density, hinted, boosted): the kind of a text from how often each kind's patterns match.

    A kind's score is `kind_score`, for files of code and plain text at least a weak prior. Medical terms add to the medical score by their number and density, and may make
    it without any pattern. Five terms a thousand words take 0.4 off the regulatory score, keywords (0.10 or more) 0.4 off the technical one and lift a low medical one
    by 0.12 unless there is legal matter. A hint with any evidence adds 0.15. Of the kinds in order of score, those found by file and by terms first among equals,
    the first wins, but for near ties: medical of 0.75 or more within 0.05; academic or medical right behind regulatory in dense medical texts; medical or academic within 0.08 of technical with medical
    keywords; the more special of two within 0.02. Without any score the kind is general, with 0.3.
    """
    zero = F.lit(0.0)
    density = terms / F.greatest(words / 1000.0, F.lit(0.1))
    dense = F.bround(density, 3)
    key = F.when(keywords > 0, F.bround(F.least(F.lit(0.25), F.lit(0.05) + keywords * 0.015), 3)).otherwise(zero)
    evident, bonus = key >= 0.10, lambda d: F.least(F.lit(0.25), terms * 0.015 + d * 0.02)
    s: dict[str, Column] = {}
    for k, n in counts.items():
        weak = F.when(file_prior["k"] == k, file_prior["s"]).otherwise(zero)
        if k == "medical":
            weak = F.when(terms > 0, F.least(F.lit(1.0), key + bonus(density))).otherwise(zero)
            s[k] = F.when(n > 0, F.least(F.lit(1.0), kind_score(n, words) + key + bonus(dense))).otherwise(weak)
        else:
            s[k] = F.when(n > 0, kind_score(n, words)).otherwise(weak)
    def weighed(r: Column) -> Column:
        s = {k: r[k] for k in counts}
        boosted = evident & (s["medical"] > 0) & (s["medical"] < 0.5) & (s["legal"] == 0)
        out = s | {
            "regulatory": F.when((dense >= 5) & (s["regulatory"] > 0), F.bround(s["regulatory"] * 0.6, 3)).otherwise(s["regulatory"]),
            "technical": F.when(evident & (s["technical"] > 0), F.bround(s["technical"] * 0.6, 3)).otherwise(s["technical"]),
            "medical": F.when(boosted, F.least(F.lit(1.0), s["medical"] + 0.12)).otherwise(s["medical"]),
        }
        return F.struct(*[v.alias(k) for k, v in out.items()], boosted.alias("boosted"))

    def ordered(r: Column) -> Column:
        s = {k: r[k] for k in counts}
        for k in HINTS:
            some = (s[k] > 0) | ((key > 0) if k in ("academic", "medical") else F.lit(False))
            s[k] = F.when((F.lower(hint) == k) & some, F.least(F.lit(1.0), s[k] + 0.15)).otherwise(s[k])
        first = lambda i, k: F.when(file_prior["k"] == k, -2).when((terms > 0) & F.lit(k == "medical"), -1).otherwise(i)
        every = [F.struct((-v).alias("s"), first(i, k).alias("o"), F.lit(k).alias("k"), F.lit(len(SPECIAL) - SPECIAL.index(k)).alias("p")) for i, (k, v) in enumerate(s.items())]
        return let(F.array_sort(F.filter(F.array(*every), lambda x: x["s"] < 0)), lambda q: chosen(q, r["boosted"]))

    hinted = F.coalesce(F.array_contains(F.array(*map(F.lit, HINTS)), F.lower(hint)), F.lit(False))

    def chosen(q: Column, boosted: Column) -> Column:
        a, b = F.get(q, F.lit(0)), F.get(q, F.lit(1))
        med = F.get(F.filter(q, lambda x: x["k"] == "medical"), F.lit(0))
        near = F.coalesce(b["s"] - a["s"], F.lit(9.0))
        rules = [
            (F.coalesce(-med["s"] >= 0.75, F.lit(False)) & (a["k"] != "medical") & F.coalesce(med["s"] - a["s"] <= 0.05, F.lit(False)), med),
            ((dense >= 5) & (near < 0.02) & (a["k"] == "regulatory") & F.coalesce(b["k"].isin("academic", "medical"), F.lit(False)), b),
            (evident & (a["k"] == "technical") & (near < 0.08) & F.coalesce(b["k"].isin("academic", "medical"), F.lit(False)), b),
            ((near < 0.02) & F.coalesce(b["p"] > a["p"], F.lit(False)), b),
        ]
        best = a
        for when, it in reversed(rules):
            best = F.when(when, it).otherwise(best)
        none = F.size(q) == 0
        top = F.transform(F.slice(q, 1, 3), lambda x: F.struct(x["k"].alias("kind"), F.round(-x["s"], 3).alias("score")))
        return F.struct(
            F.when(none, "general").otherwise(best["k"]).alias("kind"), F.when(none, 0.3).otherwise(F.round(-best["s"], 6)).alias("confidence"), F.when(b.isNull(), 0.0).otherwise(F.round(b["s"] - best["s"], 6)).alias("gap"),
            F.when(none, F.array(F.struct(F.lit("general").alias("kind"), F.lit(0.3).alias("score")))).otherwise(top).alias("candidates"), dense.alias("density"), hinted.alias("hinted"), boosted.alias("boosted"),
        )

    return let(F.struct(*[v.alias(k) for k, v in s.items()]), lambda r: let(weighed(r), ordered))


def setup(kind: Column, text: Column) -> Column:
    """struct(size, overlap, strategy) of a kind, changed by sentence length and by the text's length, inside the kind's limits."""
    return setup_by(kind, evidence(text))


def setup_by(kind: Column, e: Column) -> Column:
    """`setup` by a text's evidence."""
    pick = lambda i: F.element_at(F.create_map(*[x for k, v in SETUPS.items() for x in (F.lit(k), F.lit(v[i]))]), kind)
    w = e["words"]
    mean = e["cut_words"] / F.greatest(e["sentences"], F.lit(1))
    by = F.when(mean > 30, 1.2).when(mean < 15, 0.8).otherwise(1.0)
    size, overlap = F.floor(pick(0) * by), F.floor(pick(1) * by)
    size2 = F.when(w < 100, F.least(size, w * 4)).when(w > 10000, F.floor(size * 1.1)).otherwise(size)
    over2 = F.when(w < 100, F.least(overlap, F.floor(size2 / 4))).when(w > 10000, F.floor(overlap * 1.1)).otherwise(overlap)
    size3 = F.greatest(pick(2), F.least(size2, pick(3)))
    return F.struct(size3.cast("int").alias("size"), F.least(over2, size3 - 1).cast("int").alias("overlap"), pick(4).alias("strategy"))
