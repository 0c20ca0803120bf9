"""Text, scores and labels on single strings, held against plain models."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.functions import classify as K
from quillmark.functions import scoring as S
from quillmark.functions import text as T
from quillmark.operators import chunking as C
from quillmark.operators import dedup as D


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail A.b+c@Ex-a.Org now", "mail [redacted_email] now"), ("ssn 123-45-6789.", "ssn [SSN]."), ("call 5551234", "call [redacted_phone]"),
        ("call +1 (555) 123-4567!", "call [redacted_phone]!"), ("nothing here 123", "nothing here 123"),
    ],
)
def test_redaction(spark, text, want):
    assert one(spark, text, T.redact) == want


def test_unwrapping(spark):
    assert one(spark, "An exam-\nple that\r\ngoes on.\nnext line.\n\n\n\nNew  para\tx", T.unwrap_lines) == "An example that goes on.\nnext line.\n\nNew para x"
    assert one(spark, "", T.unwrap_lines) == ""


def test_repairs(spark):
    assert one(spark, "cafÃ© Â· 5Â°", T.repair_encoding) == "café · 5°"
    assert one(spark, "diabetesdiabetes and haha", T.collapse_doubled) == "diabetes and ha"
    assert one(spark, "teh cat adn soooooo.Then", T.correct) == "the cat and soo. Then"
    spaced = "a b c d " * 40
    assert one(spark, spaced, T.normalize) == spaced and " " not in one(spark, "a b c " * 30, T.close_letters).strip()[:10]
    assert one(spark, "wait , what....... “ok”—", T.normalize).endswith('"ok"-')


def test_steps(spark):
    steps = [{"pattern": ["a", "b"], "replace": "-"}, {"pattern": r"(x)(y)", "replace": r"\2\1", "flags": "IGNORECASE"}, {"replace": "q"}]
    assert one(spark, "aXYb", lambda c: T.apply_steps(c, steps)) == "-YX-"


@pytest.mark.parametrize("text", ["", "one", "a b a b a b c " * 4, "Wort " * 20 + "x", "The cat. Sat? On! the mat", "x" * 49, "y" * 50])
def test_shares_and_estimates(spark, text):
    w = text.split()
    assert one(spark, text, T.token_estimate) == int(len(w) * 1.3)
    assert one(spark, text, T.chunk_tokens) == max(len(text) // 4, len(w))
    assert one(spark, text, T.top_share) == pytest.approx(max(Counter(w).values()) / len(w) if w else 0)
    assert one(spark, text, S.parse_success) == (1.0 if len(text.strip()) >= 50 else 0.0)


@pytest.mark.parametrize(("n", "general", "legal"), [(0, 0, 0), (300, 0.35, 0.42), (600, 0.7, 1.0), (700, 0.85, 1.0), (900, 1.0, 0.7), (1150, 0.85, 0.5055555), (2400, 0.0, 0.0)])
def test_size_health(spark, n, general, legal):
    r = spark.range(1).select(S.size_health(F.lit(n)).alias("g"), S.size_health(F.lit(n), F.lit("legal")).alias("l")).first()
    assert (r.g, r.l) == (pytest.approx(general), pytest.approx(legal))


def test_timeliness(spark):
    day = F.lit("2024-01-11")
    f = lambda s: spark.range(1).select(S.timeliness(F.lit(s).cast("string"), day).alias("x")).first().x
    assert f("2024-01-11") == 1 and f("2024-01-01T10:00:00Z") == pytest.approx(1 - 240 / 8760) and f("2020-01-01") == 0
    assert f("2025-01-01") == f("soon") == f(None) == f("") == 0.5


def test_trust_and_rules(spark):
    assert abs(sum(S.WEIGHTS.values()) - 1) < 1e-9
    all_one = {k: F.lit(1.0) for k in S.WEIGHTS}
    r = spark.range(1).select(S.trust(all_one).alias("a"), S.trust({"completeness": F.lit(5.0)}).alias("b"), S.trust(all_one, {"completeness": 3, "validity": 1}).alias("c")).first()
    assert (r.a, r.b, r.c) == (1.0, 0.1, 1.0)
    df = spark.createDataFrame([("x1", None, 5.0)], "a string, b string, n double")
    rules = [{"type": "pattern_match", "field": "a", "pattern": "X\\d"}, {"type": "required", "field": "b"}, {"type": "other"}]
    more = [{"type": "value_match", "field": "a", "expected": None, "severity": "critical"}, {"type": "range_check", "field": "n", "min": 1, "max": 5, "severity": "low"}]
    r = df.select(S.rules_passed(rules).alias("v"), S.rules_consistent(more).alias("c"), S.playbook_completeness(F.array(F.lit("s")), F.array(F.lit("f")), ["s", "t"], ["f"]).alias("p")).first()
    assert (r.v, r.c, r.p) == (pytest.approx(2 / 3), pytest.approx(0.2 / 1.2), pytest.approx(0.7))
    assert spark.range(1).select(S.rules_passed([]).alias("x")).first().x == 1


def test_every_score_is_a_share(spark):
    texts = ["", " ", "short", "A. B. C.", "word " * 3000, "x@y.zz 555-123-4567\n\n- list\n1. item", "$$$ ### " * 30, "You should see section 5 because of 2024-01-01. " * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t, none = F.col("t"), F.lit(None).cast("string")
    cols = [S.completeness(t), S.integrity(F.lit(0.5), F.lit(0.9)), S.secure(t), S.quality(t), S.context_quality(t), S.audience_intent(t, "regulatory"), S.diversity(t), S.accessibility(t, none), S.kb_ready(t), S.connectivity(t), S.noise_free(t), S.ascii_share(t), S.letters_share(t), *[v for k, v in S.fallback(t, none, none, none, none).items() if k != "token_est"]]
    for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect():
        assert all(0 <= x <= 1 for x in r)


def test_labels(spark):
    f = lambda s: one(spark, s, lambda c: K.audience(c, F.lit("")))
    assert f("the doctor and the nurse call the ceo") == "hcp" and f("ceo doctor") == "hcp" and f("none of it") == "general"
    r = lambda s: one(spark, s, lambda c: K.route(c, F.lit("f")))
    assert [r("diabetes treatment"), r("a bank, banking and finance"), r("fda label"), r("plain words")] == ["MEDICAL", "FINANCIAL", "REGULATORY", "TECH"]
    assert one(spark, "x doctor", lambda c: K.with_rules(F.lit("general"), c, [{"pattern": "DOCTOR", "audience": "hcp"}])) == "hcp"


@pytest.mark.parametrize(("text", "kind"), [("whereas the party hereby signs this agreement and contract", "legal"), ("def f(x):\n  return x\nimport os\nx = 1\n# note", "code"), ("", "general"), ("patient treatment diagnosis of a disease with medication", "medical")])
def test_content_kinds(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    x = df.select("t", T.n_words(F.col("t")).alias("w"), *[K.kind_matches(F.col("t"), k).alias(k) for k in K.KINDS])
    counts = {k: sum(len(re.findall(p, text, re.I | re.M)) for p in K.KINDS[k]) for k in K.KINDS}
    assert {k: x.first()[k] for k in K.KINDS} == counts
    r = detected(spark, [(text, None, None)])[0]
    assert r.kind == kind and 0.3 <= r.confidence <= 1 and r.s.overlap < r.s.size


def detected(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, f string, h string")
    x = df.select("i", "t", "h", T.n_words(F.col("t")).alias("w"), K.prior(F.col("f")).alias("prior"), *[c.alias(k) for k, c in K.medical_evidence(F.col("t")).items()], *[K.kind_matches(F.col("t"), k).alias(k) for k in K.KINDS])
    c = K.detect({k: F.col(k) for k in K.KINDS}, F.col("w"), F.col("keywords"), F.col("terms"), F.col("prior"), F.col("h"))
    return x.withColumn("c", c).select("i", "c.*", K.setup(F.col("c.kind"), F.col("t")).alias("s")).orderBy("i").collect()


def plain_kind(text, filename, hint):
    """The rules of detection in a plain loop over dictionaries, in the order in which kinds come up."""
    scores, low, n = {}, text.lower(), len(text.split())
    end = re.search(r"[^./](\.[^./]*)$", (filename or "").lower())
    if end and end[1] in K.CODE_FILES:
        scores["code"] = 0.35
    elif end and end[1] in K.TEXT_FILES:
        scores["documentation"] = 0.25
    words = [w for w in K.MEDICAL_KEYWORDS if w in low]
    said = [m[0].strip()[:80] for p in K.CLINICAL for m in re.finditer(p, text, re.I)]
    terms = min(50, len({*words, *(w for w in K.MEDICAL_SUBJECTS if w in low), *said}))
    density = terms / max(n / 1000, 0.1)
    key = round(min(0.25, 0.05 + len(words) * 0.015), 3) if words else 0.0
    if terms:
        scores["medical"] = min(1.0, key + min(0.25, terms * 0.015 + density * 0.02))
    for kind, patterns in K.KINDS.items():
        c = sum(len(re.findall(p, text, re.I | re.M)) for p in patterns)
        if c:
            s = min(1.0, math.log1p(c) / math.log1p(8)) * 0.6 + min(1.0, c / max(n / 1000, 1.0) / 1.5) * 0.4
            s = min(1.0, s + min(0.15, (c - 3) * 0.02)) if c >= 3 else s
            scores[kind] = min(1.0, s + key + min(0.25, terms * 0.015 + round(density, 3) * 0.02)) if kind == "medical" else s
    dense = round(density, 3)
    if dense >= 5 and "regulatory" in scores:
        scores["regulatory"] = round(scores["regulatory"] * 0.6, 3)
    if key >= 0.1 and "technical" in scores:
        scores["technical"] = round(scores["technical"] * 0.6, 3)
    if key >= 0.1 and 0 < scores.get("medical", 0) < 0.5 and "legal" not in scores:
        scores["medical"] += 0.12
    if hint in K.HINTS and (scores.get(hint, 0) > 0 or (hint in ("academic", "medical") and key > 0)):
        scores[hint] = min(1.0, scores.get(hint, 0.0) + 0.15)
    if not scores:
        return "general", 0.3, 0.0, ["general"]
    q = sorted(scores.items(), key=lambda x: -x[1])
    (best, top), (second, near) = q[0], (q[1] if len(q) > 1 else (None, -9.0))
    med = scores.get("medical", 0)
    if med >= 0.75 and best != "medical" and top - med <= 0.05:
        out = ("medical", med)
    elif dense >= 5 and top - near < 0.02 and best == "regulatory" and second in ("academic", "medical"):
        out = (second, near)
    elif key >= 0.1 and best == "technical" and second in ("academic", "medical") and top - near < 0.08:
        out = (second, near)
    elif second and top - near < 0.02 and K.SPECIAL.index(second) < K.SPECIAL.index(best):
        out = (second, near)
    else:
        out = (best, top)
    return out[0], out[1], out[1] - near if second else 0.0, [k for k, _ in q[:3]]


def test_detection_equals_plain_rules(spark):
    parts = ["the patient with diabetes had a clinical trial and insulin therapy", "whereas the party hereby signs the contract", "supervisor risk monitoring compliance standard framework", "abstract introduction study results hypothesis",
             "the database table index query api endpoint", "bank capital liquidity audit interest rate", "# title\n* item\n1. first", "def f(x):\n  return x\nimport os", "10:15 AM hello\nBob: hi there", "plain words without any mark", "who guidelines for screening, mortality and morbidity"]
    rng, rows = random.Random(4), [("", None, None), ("", "a.py", "medical"), ("insulin", "b.md", "academic")]
    for _ in range(80):
        text = "\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) + " filler" * rng.choice([0, 30, 900])
        rows.append((text, rng.choice([None, "x.py", "Y.MD", "z.pdf", "noending", "dir.x/.py"]), rng.choice([None, None, *K.HINTS, "code"])))
    for r, row in zip(detected(spark, rows), rows, strict=True):
        kind, confidence, gap, top = plain_kind(*row)
        assert (r.kind, [c["kind"] for c in r.candidates]) == (kind, top), row
        assert abs(r.confidence - min(1.0, confidence)) < 1e-6 and abs(r.gap - gap) < 1e-6, row


@pytest.mark.parametrize("strategy", sorted(C.STRATEGIES))
@pytest.mark.parametrize("text", ["", "word", "x" * 5000, "No end of it " * 400, "One. Two! Three? " * 200, "Para one.\n\nPara two is longer.\n\n" * 60, "  in\n    dent\n  ed\n" * 40])
def test_chunks_keep_every_word(strategy, text):
    out = C.STRATEGIES[strategy](text, 50, 1, 40)
    assert all(c.strip() for c in out)
    joined = " ".join(out)
    if strategy in ("semantic", "paragraph_boundary", "sentence", "sentence_boundary", "recursive"):
        assert set(re.findall(r"\w+", text)) <= set(re.findall(r"\w+", joined))
        assert all(C.estimate(c) <= 50 or len(c) <= 200 or len(c.split()) == 1 for c in out)


def test_sentence_packing():
    text = ". ".join(f"S{i} aaa bbb ccc" for i in range(12)) + "."
    out = C.by_sentences(text, 12, keep=1)
    assert all(a.split("S")[-1] == "" or b.startswith("S" + a.rsplit("S", 1)[1].split(".")[0].strip()[:2].strip()) for a, b in zip(out, out[1:], strict=False))
    assert C.merge_tiny(["a b", "c d", "e f", "g h"], 100) == ["a b\n\nc d\n\ne f", "g h"] and C.merge_tiny([]) == []
    assert C.merge_headings(["1. Title", "body text here"]) == ["1. Title\n\nbody text here"]
    assert C.limits(0, 0) == (900, 300) and C.limits(20000, 10) == (4000, 10) and C.limits(10, 900) == (10, 39)


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 70, 71, 200])
def test_char_windows(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    got = one(spark, text, lambda c: C.char_chunks(c, 10, 10))
    assert got == C.by_characters(text, 10, 0, 10)
    want, start = [], 0
    while start < n:
        end = min(n, start + 40)
        want.append(text[start:end])
        if end >= n:
            break
        start = max(end - 10, start + 1)
    assert got == want


def test_pages_and_sections(spark):
    df = spark.createDataFrame([(1, "before\n=== PAGE 3 ===\n# A\nbody\n=== PAGE 4 ===\nmore"), (2, "no fence"), (3, "")], "id bigint, text string")
    got = {(r.id, r.page, r.text) for r in C.pages(df, "id").collect()}
    assert got == {(1, 1, "before"), (1, 3, "# A\nbody"), (1, 4, "more"), (2, 1, "no fence"), (3, 1, "")}
    s = spark.createDataFrame([(1, "intro\n\n1. First Part\nx\ny\nEXECUTIVE SUMMARY\nz"), (2, "")], "id bigint, text string")
    got = [(r.id, r.title, r.section, r.confidence, r.body) for r in C.sections(s, "id").orderBy("id", "ord").collect()]
    assert got == [(1, "Introduction", "introduction", 0.5, "intro"), (1, "1. First Part", "1_first_part", 0.8, "x\ny"), (1, "EXECUTIVE SUMMARY", "executive_summary", 0.8, "z"), (2, "Introduction", "introduction", 0.0, "")]


def test_duplicate_scores(spark):
    rows = [(1, 0, "the same text here"), (1, 1, "the same text here"), (2, 0, "alone in here"), (3, 0, "abcdefgh"), (3, 1, "zyxwvuts"), (3, 2, "")]
    df = spark.createDataFrame(rows, "doc bigint, chunk_index int, text string")
    got = {r.doc: r.score for r in D.duplicate_score(df, "doc").collect()}
    assert got == {1: 30.0, 2: 100.0, 3: 100.0}


def grams(t):
    t = " ".join(t.lower().split())
    return {t[i : i + 5] for i in range(len(t) - 4)}


def test_duplicate_scores_by_blocks(spark, monkeypatch):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "é😀ü", "x", *[chr(0x4E00 + 7 * i) for i in range(400)]]
    rows = [(d, i, " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 30))))) for d, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)]
    rows += [(1, 100 + i, "again the same text") for i in range(9)]
    df = spark.createDataFrame(rows, "doc bigint, chunk_index int, text string")
    want = {}
    for d in (1, 2, 3):
        sets = [g for k, _, t in rows if k == d and (g := grams(t))]
        pairs = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
        want[d] = (sum(k == d for k, *_ in rows), len(pairs), round(sum(pairs) / max(1, len(pairs)), 6))
    for chunks in (512, 7):  # all of a document at once, and in blocks
        monkeypatch.setattr(D, "BLOCK_CHUNKS", chunks)
        assert {r.doc: (r.n_chunks, r.pairs, r.overlap) for r in D.duplicate_score(df, "doc").collect()} == want


def test_duplicate_scores_join_no_shingles(spark):
    """The small size of a compressed table doesn't bring its shingles to the driver."""
    df = spark.createDataFrame([(1, 0, "the same text"), (1, 1, None), (None, 0, "the same text"), (None, 1, "the same text"), (2, 0, "one index"), (2, 0, "twice here")], "doc bigint, chunk_index int, text string")
    x = D.duplicate_score(df.withColumn("text", T.text_of("text")), "doc")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "LeftOuter" in plan  # the one with documents of many blocks
    assert {r.doc: (r.n_chunks, r.pairs, r.overlap) for r in x.collect()} == {1: (2, 0, 0.0), None: (2, 0, 0.0), 2: (2, 1, 0.0)}


def test_metadata_by_ascii_words(spark):
    got = one(spark, "é2024-01-02 _1/2/20 日v1.2 ver\u017Fion 2.3.1 by:\x0bNo One By: Karl \u212Aurz Augu\u017Ft 4, 2020 May\x0b3, 2021 1/2/2020é", T.metadata)
    assert (got.dates, got.versions, got.author) == (["1/2/2020", "Augu\u017Ft", "2024-01-02"], ["1.2", "2.3.1"], "Karl \u212Aurz Augu\u017Ft")


def test_long_work_is_dealt_over_all_cores(spark):
    """The smallest table is one row group, which was one task."""
    from quillmark.queries import queries

    for name in ("audience_intent", "fallback_metrics", "repeated_ngrams_removed", "content_kinds", "advice_by_document", "section_coverage"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id#" in plan and plan.count("REPARTITION_BY_NUM") == 1, name


def odd_texts():
    """Parts of the patterns of kinds with odd cases, signs and blanks among them."""
    rng = random.Random(11)
    parts = sorted({w for ps in K.KINDS.values() for p in ps for w in re.findall(r"[A-Za-z]{2,}", p)} | {*K.MEDICAL_KEYWORDS, *K.MEDICAL_SUBJECTS, "patients with x", "type 1 diabetes", "adverse event", "treatment of Y"})
    parts += ["10:15 AM hi", "Bob: hi", "[a](b)", "[a] (b)", "[x] y", "<a> b", "```py", "# t", "* i", "1. x", "1.2 x", "// c", "/* c */", "a = b = c", "f(x)", "from if x", "import"] * 4
    gaps = [*" " * 9, *"\n\n\n\t\r\x0b\x0c\x85\xa0\u3000_-.!?é日0\x00\x02\x03\x1c:([]=", "\n  ", "\n\n", "\r\n", ". ", ""]
    odd = [str, str, str, str.upper, str.title, *[lambda w, a=a, b=b: w.replace(a, b) for a, b in (("s", "\u017f"), ("k", "\u212a"), ("i", "\u0130"), ("i", "\u0131"))]]
    rows = ["", " ", ".", " . . ", None, "# a\n# b\n#c", "import\nfrom x", "import\n  from x", "a = b = c\nd=e=f", "[a](b) [c](d)", "[" * 300, "x" * 5000, "\n" * 20_000 + "#"]
    return rows + ["".join(rng.choice(odd)(rng.choice(parts)) + rng.choice(gaps) for _ in range(rng.choice((1, 3, 10, 40, 200)))) for _ in range(600)]


def test_content_kinds_of_odd_texts_are_those_of_their_sql(spark, tmp_path):
    from quillmark.queries import oracle_sql, queries

    rows = [(i, t, "en", ("a.", "", None, "b")[i % 4], 1) for i, t in enumerate(odd_texts())]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cells = lambda found: {r[0]: [f"{v:.9g}" if isinstance(v, float) else v for v in r[1:]] for r in found}
    got, want = cells(map(tuple, queries()["content_kinds"](spark, str(tmp_path)).collect())), cells(duck.execute(oracle_sql()["content_kinds"]).fetchall())
    assert len(got) == len(rows) and [i for i in want if got[i] != want[i]] == []


def test_content_kinds_look_at_texts_once(spark):
    """One pass over batches of texts: no pattern is tried text by text."""
    from quillmark.queries import queries

    plan = queries()["content_kinds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all(text" not in plan and "lower(text" not in plan
    assert K.evidence.func(pa.array([], pa.string())).to_pylist() == []
