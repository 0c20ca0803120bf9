"""Secret scan, quality rules, classifier, token counts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import classifier, counts, quality_rules, secrets
from quillmark.llm.common import table

DATA = "/root/testdata/sf0.001"
KINDS = ("assign", "access", "hex")


def brute_spans(text):
    """The fixed patterns as they are stated, with the length tests afterwards."""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secrets_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    rows = secrets.op2_secret_scan(spark, DATA).collect()
    assert len(rows) == len(docs)
    found = 0
    for r in rows:
        base = brute_spans(docs[r.doc_id])
        said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in base) for j in range(3)]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
        found += len(base)
    assert found


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abcdef0123456789AKIXpswordTOKENketi_=: \"'-é😀")), max_size=80))
def test_fixed_patterns_on_any_text(text):
    assert sorted(secrets.base_spans(text)) == brute_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abcdefgh01"), max_size=60), st.integers(2, 20), st.floats(0.5, 3.2))
def test_windows_by_recount(text, width, least):
    hit = set()
    for i in range(len(text) - width + 1):
        h = -sum(c / width * math.log2(c / width) for c in Counter(text[i : i + width]).values())
        if abs(h - least) < 1e-6:
            return
        if h >= least:
            hit |= set(range(i, i + width))
    got = secrets.windows(text, width, least)
    assert {p for a, b in got for p in range(a, b)} == hit and all(got[i][1] < got[i + 1][0] for i in range(len(got) - 1))


def test_entropy_and_allow_list(spark):
    texts = ["x Zk8Qp2Lw9Xv4Rt7Yb1Nc6 y", "id 123e4567-e89b-42d3-a456-426614174000 z", "abcdefghijklmnopqrstuvwxyz123", "internationalisation_of_things", "path/to/some/file/in/here/x", "token=EXAMPLEZk8Qp2Lw9Xv4Rt7"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in secrets.find_secrets(df).collect()}
    assert [got[i].n_entropy > 0 for i in range(6)] == [True, False, False, False, False, False] and got[5].n_assign == 1
    free = {r.doc_id: r.n_entropy for r in secrets.find_secrets(df, allow=[r"nothing"]).collect()}
    assert free[2]


@pytest.mark.parametrize("front", ["", "sid=", "build/", "prod-", "key_", "X", "7f="])
def test_values_have_their_own_limit_behind_a_name(front):
    """Upper-case hex keys and long numbers are found behind a name as they are alone; words and even numbers are not."""
    rng = random.Random(11)
    allow, _ = secrets.allowed(secrets.ALLOW)
    for alphabet, n in (("0123456789ABCDEF", 40), ("0123456789", 60)):
        for _ in range(200):
            value = "".join(rng.choice(alphabet) for _ in range(n))
            alone, behind = (secrets.entropy_spans(x, 20, allow) for x in (value, front + value))
            cover = [{p - k for a, _, b in spans for p in range(a, b)} for spans, k in ((alone, 0), (behind, len(front)))]
            assert cover[0] <= cover[1] and (alphabet != "0123456789ABCDEF" or cover[0])
            assert all(behind[i][2] < behind[i + 1][0] for i in range(len(behind) - 1))
    assert secrets.entropy_spans("31415926407852193607", 20, allow) and not secrets.entropy_spans("11112222333344445555", 20, allow)
    assert not secrets.entropy_spans(front + "internationalisation", 20, allow)


def test_allowed_parts_hide_no_more_than_themselves(spark):
    """A filler, an alphabet or 'example' inside a candidate leaves the rest of it to be searched."""
    key = "Zk8Qp2Lw9Xv4Rt7Yb1Nc6Hd3Gm5"
    texts = [f"AAAAAAAAAAAA{key}", f"example_{key}", f"{key}0123456789", f"{key}abcdefghij{key}", "AAAAAAAAAAAAAAAAAAAAAAAAA1", "Zk8Qp2Lw9Xv4RexampleQp2Lw9Xv4RtZ"]
    rows = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    spans = {i: [(s.start, s.end) for s in rows[i] if s.kind == "entropy"] for i in rows}
    assert spans[0][0][0] >= 12 and spans[0][-1][1] == len(texts[0]) and spans[1][-1][1] == len(texts[1]) and spans[1][0][0] >= 7
    assert spans[2] == [(0, len(key))] and spans[3] == [(0, len(key)), (len(key) + 10, len(texts[3]))]
    assert spans[4] == [] and spans[5] == []


def test_planted_secrets_are_found_and_plain_texts_are_not(spark):
    """Random keys of many kinds, bare and behind names and paths: recall of 0.9 or more by entropy alone, and nothing in prose with long words, paths, lines and UUIDs."""
    rng = random.Random(31)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = {"base64": lambda: pick(low + up + num + "+/", 40), "urlsafe": lambda: pick(low + up + num + "-_", 32), "HEX": lambda: pick(num + "ABCDEF", 32), "alnum": lambda: pick(low + num, 30), "ALNUM": lambda: pick(up + num, 28)}
    fronts = ["", "sid=", "x-session-", "/srv/app/", "KEY_", "https://host/path/", "export NAME="]
    rows, want = [], {}
    for i, (k, f) in enumerate((k, f) for k in kinds for f in fronts for _ in range(12)):
        key = kinds[k]()
        rows.append((i, f"some words here {f}{key} and there"))
        want[i] = (k, len(f) + 16, len(f) + 16 + len(key))
    plain = ["a/plain/path/to/some/file_name/in/folders", "https-and-dashes-in-a-long-line-of-words", "123e4567-e89b-12d3-a456-426614174000", "Donaudampfschifffahrtsgesellschaftskapitaen", "src/main/java/Some/Thing12/V2/index", "====================----------", "AAAAAAAAAAAAAAAAAAAAAAAAAAAA"]
    rows += [(10_000 + i, t) for i, t in enumerate(plain)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "entropy"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    hit = Counter(k for i, (k, a, b) in want.items() if sum(max(0, min(b, e) - max(a, s)) for s, e in got[i]) >= 0.6 * (b - a))
    all_ = Counter(k for k, _, _ in want.values())
    assert sum(hit.values()) >= 0.95 * len(want) and all(hit[k] >= 0.9 * all_[k] for k in kinds), (hit, all_)
    assert not any(got[10_000 + i] for i in range(len(plain)))


def test_secrets_of_odd_rows(nasty, none):
    assert secrets.find_secrets(nasty).count() == nasty.count() and secrets.find_secrets(none).count() == 0
    assert {r.n_hex for r in secrets.find_secrets(nasty.filter("text IS NULL")).collect()} == {0}


def brute_facts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = set()
    dup = 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab# |\n\t\x0b\xa0\x1cé")), max_size=60))
def test_counts_of_any_text(text):
    got = quality_rules.facts(text.encode())
    want = brute_facts(text)
    assert got == (want if want[0] else (0, 0, 0, 0, 0)) or (want[0] == 0 and got[0] == 0)


def test_rules_against_brute_force(spark):
    docs = {r.doc_id: r for r in table(spark, DATA, "documents").collect()}
    rows = quality_rules.op3_quality_rules(spark, DATA).collect()
    assert len(rows) == len(docs)
    fails, n = Counter(), Counter()
    for r in rows:
        w = brute_facts(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == w
        assert r.base_failed == (w[0] < 10 or 100 * w[4] > 20 * w[0])
        fails[r.source] += r.base_failed
        n[r.source] += 1
    rates = {s: fails[s] / n[s] for s in n}
    m = sum(rates.values()) / len(rates)
    v = sum((x - m) ** 2 for x in rates.values()) / len(rates)
    noise = m * (1 - m) * sum(1 / c for c in n.values()) / len(n)
    s = min(10000, max(1, m * (1 - m) / (v - noise) - 1)) if v > noise else 10000
    for r in rows:
        rate = (fails[r.source] + m * s) / (n[r.source] + s)
        assert r.host_rate == pytest.approx(rate, abs=1e-6) and r.kept == (not r.base_failed and rate <= 0.5)


def test_bad_hosts_are_rejected_and_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(20)), "x"
    rows = [(i, good, f"g{i % 8}") for i in range(400)] + [(1000 + i, bad if i % 10 else good, "spam") for i in range(100)] + [(2000, bad, "tiny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in quality_rules.host_rules(df).collect()}
    assert not got[1000].kept and not got[1000].base_failed and got[0].kept and 0 < got[2000].host_rate < 1


def test_the_query_rejects_hosts_as_its_sql_does(spark, tmp_path):
    """Documents in which a host's rate, shrunk by the prior, takes good documents with it, through the registered query and its SQL."""
    import duckdb

    rng = random.Random(17)
    good, bad = " ".join(f"w{i}" for i in range(20)), "too short"
    rows = []
    for h in range(24):
        rate = 0.95 if h % 8 == 0 else 0.02
        rows += [(len(rows) + i, bad if rng.random() < rate else good + f" {h} {i}", "en", None if h == 5 else f"host{h}") for i in range(rng.choice([3, 60, 200]))]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    df = quality_rules.op3_quality_rules(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = c.execute(quality_rules.OP3_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))
    taken = df.filter("NOT kept AND NOT base_failed").count()
    assert 0 < taken < 0.2 * len(rows) and df.filter("kept").count() > 0.5 * len(rows)


def test_rules_of_odd_rows(nasty, none):
    out = quality_rules.host_rules(nasty)
    assert out.count() == nasty.count() and out.columns.count("kept") == 1 and not out.filter("text_x = 1" if "text_x" in out.columns else "n_words = 0 AND kept").count()
    assert quality_rules.host_rules(none).count() == 0


def test_classifier_on_the_fold_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    rows = classifier.op8_quality_classifier(spark, d).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    seen = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q, _ in seen if q], [s for s, q, _ in seen if not q]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(p for _, q, p in seen if q) / len(good) > 0.95 and sum(p for _, q, p in seen if not q) / len(bad) < 0.1


def plain_scores(docs, labels, threshold=0.7):
    """The discriminant by its textbook form: log densities by solve and slogdet of the shrunken covariances, from all labelled rows outside the held-out fold."""
    x = {i: np.array(classifier.statistics(t or "")) for i, t in docs}
    d = len(classifier.FEATURES)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    rows = {k: np.array([x[i] for i, _ in docs if labels.get(i) == k and not held(i)]) for k in (0, 1)}
    n = {k: len(v) for k, v in rows.items()}
    cov = {k: np.cov(v.T, bias=True) for k, v in rows.items()}
    pooled = sum(n[k] * cov[k] for k in n) / sum(n.values())
    pooled = pooled + np.eye(d) * (0.05 * np.trace(pooled) / d + 1e-6)
    out = {}
    for i, v in x.items():
        log = {}
        for k in (0, 1):
            w = max(0.15, min(1.0, 2 * d / n[k]))
            c = (1 - w) * cov[k] + w * pooled + np.eye(d) * 1e-6
            m = v - rows[k].mean(axis=0)
            log[k] = np.log((n[k] + 1) / (sum(n.values()) + 2)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * m @ np.linalg.solve(c, m)
        out[i] = 1 / (1 + np.exp(-np.clip(0.25 * (log[1] - log[0]), -700, 700)))
    return out


def test_scores_equal_a_plain_discriminant(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, d, "documents").collect()]
    want = plain_scores(docs, {r.doc_id: r.quality for r in table(spark, d, "labels").collect()})
    got = {r.doc_id: (r.score, r.predicted) for r in classifier.op8_quality_classifier(spark, d).collect()}
    assert len(got) == len(want) and max(abs(got[i][0] - s) for i, s in want.items()) < 1e-6
    assert all(got[i][1] == (s >= 0.7) for i, s in want.items() if abs(s - 0.7) > 1e-6)


def test_scores_ignore_held_out_labels(spark):
    d = DATA
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = ({r.doc_id: r.score for r in classifier.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_classifier_of_odd_rows(spark, nasty, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (None, 1), (7, None), (8, 5)], "doc_id bigint, quality int")
    out = classifier.classify(nasty, labels).collect()
    assert len(out) == nasty.count() and all(r.score is not None and 0 <= r.score <= 1 for r in out)
    assert classifier.classify(none, labels).count() == 0
    bare = classifier.classify(nasty, labels.filter("false")).collect()
    assert {round(r.score, 6) for r in bare} == {0.5}


def test_counts_equal_the_corpus(spark):
    from quillmark.llm.tokens import RANKS, encoder

    encode = encoder(open(RANKS, "rb").read()).encode_ordinary
    want = defaultdict(lambda: [0, 0])
    for r in table(spark, DATA, "documents").collect():
        for v, n in ((counts.BPE, len(encode(r.text))), (counts.WORDS, len(r.text.encode().split()))):
            w = want[(r.source, r.lang, v)]
            w[0] += 1
            w[1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in counts.op10_token_counts(spark, DATA).collect()}
    assert got == dict(want)


def test_rollup_by_deltas_equals_a_recount(spark, tmp_path):
    c = lambda rows: spark.createDataFrame(rows, "doc_id bigint, source string, lang string, tokenizer string, tokens bigint")
    r = counts.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    a = c([(1, "a", "en", "t1", 10), (2, "a", None, "t1", 5), (3, None, "de", "t1", 7)])
    assert r.commit("b1", counts.inserts(a)) and not r.commit("b1", counts.inserts(a))
    r.commit("b2", counts.deletes(c([(3, None, "de", "t1", 7)])))
    r.commit("b3", counts.revisions(c([(1, "a", "en", "t1", 10)]), c([(1, "b", "en", "t2", 12)])))
    want = {("b", "en", "t2"): (1, 12), ("a", None, "t1"): (1, 5)}
    got = lambda: {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in r.totals().collect()}
    assert got() == want
    r.compact()
    assert got() == want and not r.commit("b2", counts.inserts(a)) and len(r.live()) == 1
    r.commit("b4", counts.inserts(c([(9, "a", None, "t1", 1)])))
    assert got()[("a", None, "t1")] == (2, 6)
    with pytest.raises(ValueError):
        r.commit("a/b", counts.inserts(a))


def test_unfinished_batches_do_not_count(spark, tmp_path):
    r = counts.Rollup(spark, f"file://{tmp_path}/r")
    df = spark.createDataFrame([("a", "en", "t", 1, 5)], "source string, lang string, tokenizer string, docs bigint, tokens bigint")
    r.commit("b1", df)
    next((tmp_path / "r" / "batch=b1").glob("attempt=*/totals/_SUCCESS")).unlink()
    assert r.totals().count() == 0 and r.commit("b1", df) and r.totals().first().tokens == 5


def test_counts_of_odd_rows(nasty, none):
    assert counts.count_tokens(nasty).count() == 2 * nasty.count() and counts.count_tokens(none).count() == 0


def test_sums_of_any_name_keep_the_totals(spark, tmp_path):
    """Compactions of any name, two at once, empty batches and a second writer of one name change nothing."""
    kind = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
    df, none = spark.createDataFrame([("a", "en", "t", 1, 10), (None, None, "t", None, 0)], kind), spark.createDataFrame([], kind)
    r = counts.Rollup(spark, f"file://{tmp_path}/r")
    got = lambda: {x.source: (x.docs, x.tokens) for x in r.totals().collect()}
    r.commit("b1", df), r.commit("sum-b2", df), r.commit("nothing", none)
    assert got() == {"a": (2, 20)}
    assert r.compact("daily") and got() == {"a": (2, 20)} and not r.compact("daily") and not r.compact()
    assert not r.commit("sum-b2", df) and not r.commit("nothing", df) and got() == {"a": (2, 20)}
    r.commit("daily", df)
    assert got() == {"a": (3, 30)} and r.compact("b1") and got() == {"a": (3, 30)}
    r.commit("b3", df), r.commit("b4", df)
    before = r.live()
    for name in ("first", "second"):  # both began from the same state
        r._write("sum", name, r._changes(before), list(before))
    assert got() == {"a": (5, 50)} and len(r.live()) == 1
    r.commit("b5", df)
    both = tmp_path / "r" / "batch=b5"
    shutil.copytree(next(both.iterdir()), both / "attempt=99999999999999999999-late")
    assert got() == {"a": (6, 60)} and r.compact() and got() == {"a": (6, 60)}
    empty = counts.Rollup(spark, f"file://{tmp_path}/e")
    assert empty.commit("x", none) and empty.totals().count() == 0 and not empty.compact()


def test_the_query_runs_all_kinds_of_changes(spark, monkeypatch):
    """Over whole documents: revisions, deletes, repeated batches and a compaction leave the sums of a plain count."""
    done, write = [], counts.Rollup._write

    def record(self, kind, name, changes, holds):
        done.append((kind, name, write(self, kind, name, changes, holds), changes.agg({"docs": "min"}).first()[0]))
        return done[-1][2]

    monkeypatch.setattr(counts.Rollup, "_write", record)
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in counts.op10_token_counts(spark, DATA).collect()}
    assert [d[1:3] for d in done] == [("load", True), ("languages", True), ("deleted", True), ("inserted", True), ("languages", False), ("daily", True), ("load", False)]
    assert done[1][3] == done[2][3] == -1 and done[5][0] == "sum"
    plain = counts.count_tokens(table(spark, DATA, "documents")).groupBy("source", "lang", "tokenizer").agg({"tokens": "sum", "*": "count"}).collect()
    assert got == {(r["source"], r["lang"], r["tokenizer"]): (r["count(1)"], r["sum(tokens)"]) for r in plain}
