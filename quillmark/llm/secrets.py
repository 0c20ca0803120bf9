"""Secret scans: fixed patterns, and windows of high Shannon entropy by character class."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run that is too short never hides a longer one in these two, so the length is in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Character classes from narrow to wide: name, the class's own runs, least entropy in bits of a window of 20 characters.
#: Upper and lower case are entries of their own, as a run that either may start must be as long as it can be.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), 3.1),
    ("hex", re.compile(r"[0-9a-f]+"), 3.0),
    ("hex", re.compile(r"[0-9A-F]+"), 3.0),
    ("lower", re.compile(r"[a-z0-9]+"), 3.6),
    ("lower", re.compile(r"[A-Z0-9]+"), 3.6),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7),
)
#: Candidates that match one of these wholly are no secrets: words, dashed lines, file paths of words in one case with a few digits behind, UUIDs. A compiled pattern stands for a part
#: of a candidate, alphabets and fillers: only windows that overlap such a part are left out.
ALLOW = (
    r"[A-Za-z]+",
    r"[-_=+/]+",
    r"[A-Za-z]+(?:[-_/+=][A-Za-z]+)*[-_/+=]*",
    r"/?(?:(?:[A-Z]?[a-z_-]*|[A-Z_-]*)[0-9]{0,4}/)+(?:[A-Z]?[a-z_-]*|[A-Z_-]*)[0-9]{0,4}",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    re.compile(r"0123456789|abcdefghij|ABCDEFGHIJ|[Ee]xample|EXAMPLE|(.)\1{7,}"),
)


def windows(text: str, width: int, least: float) -> list[tuple[int, int]]:
    """The union of all windows of `width` characters whose Shannon entropy is `least` bits or more, as (start, end).

    Counts are changed by one character out and one in, so a window costs the same at any width.
    """
    n = len(text)
    if n < width:
        return []
    clog = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    limit = width * (math.log2(width) - least) + 1e-9  # of the sum of c log c
    counts: dict[str, int] = {}
    total = 0.0
    for ch in text[:width]:
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += clog[c + 1] - clog[c]
    found: list[tuple[int, int]] = []
    for i in range(n - width + 1):
        if total <= limit:
            if found and i <= found[-1][1]:
                found[-1] = (found[-1][0], i + width)
            else:
                found.append((i, i + width))
        if i + width < n:
            out, new = text[i], text[i + width]
            c = counts[out]
            counts[out] = c - 1
            total += clog[c - 1] - clog[c]
            c = counts.get(new, 0)
            counts[new] = c + 1
            total += clog[c + 1] - clog[c]
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost matches that don't overlap, then the length tests."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def allowed(allow: Sequence[str | re.Pattern]) -> tuple[re.Pattern, list[re.Pattern]]:
    """One pattern of all that are matched wholly, and those of parts."""
    return re.compile("|".join(f"(?:{p})" for p in _numbered([p for p in allow if isinstance(p, str)])) or r"(?!)"), [p for p in allow if not isinstance(p, str)]


def entropy_spans(text: str, width: int, allow: re.Pattern, parts: Sequence[re.Pattern] = (), classes: Sequence = CLASSES) -> list[tuple[int, int, int]]:
    """(start, 3, end) of windows over the limit of their class: of every class the longest runs inside a candidate are searched,
    unless a narrower class holds the whole run or `allow` matches it, so a name or path in front of a value doesn't change its limit.
    Runs are searched between what `parts` match in a candidate. Windows that overlap are one span."""
    out = []
    for m in CANDIDATE.finditer(text):
        if allow.fullmatch(m[0]):
            continue
        out_of = sorted(x.span() for p in parts for x in p.finditer(m[0]))
        seen: set[tuple[int, int]] = set()
        found: list[tuple[int, int]] = []
        for _, p, least in classes:
            for r in p.finditer(m[0]):
                if r.end() - r.start() >= width and r.span() not in seen:
                    seen.add(r.span())
                    if not allow.fullmatch(r[0]):
                        found += [(s + a, s + b) for s, e in between(*r.span(), out_of) for a, b in windows(m[0][s:e], width, least)]
        stop = -1
        for a, b in sorted(found):
            a, b = m.start() + a, m.start() + b
            if a <= stop:
                stop = max(stop, b)
                out[-1] = (out[-1][0], 3, stop)
            else:
                stop = b
                out.append((a, 3, b))
    return out


def between(start: int, end: int, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of start to end lies between the sorted parts."""
    out = []
    for a, b in parts:
        if start < min(a, end):
            out.append((start, min(a, end)))
        start = max(start, b)
    return [*out, (start, end)] if start < end else out


def scan(text: str, width: int, allow: re.Pattern, parts: Sequence[re.Pattern] = (), classes: Sequence = CLASSES) -> tuple[list, list]:
    base = sorted(base_spans(text))
    return base, sorted(base + entropy_spans(text, width, allow, parts, classes))


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 20, allow: Sequence[str | re.Pattern] = ALLOW, classes: Sequence = CLASSES) -> DataFrame:
    """A row for each row of df: its id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans (array of kind, start, end).

    Spans count code points, end exclusive, in order of start, then kind. Candidate strings of 20 or more characters that no pattern
    of `allow` matches wholly are searched by `windows`, each run of a character class inside them at the limit of its class; the fixed
    patterns are found in any case. Rows are independent: no shuffle, and a batch of bounded bytes in memory.

    Nulls: a null text counts as '' and has no spans; a null id is kept. Repeated rows give equal rows. An empty table gives an
    empty result. Only the id and the text are read; other columns have no effect, whatever their names.
    """
    one, parts = allowed(allow)
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            sha, spans = [], []
            for t in b.column(1).to_pylist():
                base, every = scan(t or "", width, one, parts, classes)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in every))
                sha.append(hashlib.sha256(_said(base).encode()).hexdigest())
                spans.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in every])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, kind)], names)

    names = [id_col, "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]
    schema = f"`{id_col}` {id_type}, n_assign bigint, n_access bigint, n_hex bigint, n_entropy bigint, base_sha256 string, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return arrow_map(df.select(id_col, text), run, schema)


def _numbered(allow: Sequence[str]) -> list[str]:
    """Patterns with their back-references moved to where their groups are once the patterns are joined."""
    out, groups = [], 0
    for p in allow:
        out.append(re.sub(r"\\([1-9])", lambda m, g=groups: f"\\{int(m[1]) + g}", p))
        groups += re.compile(p).groups
    return out


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; the spans as one string."""
    return find_secrets(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "array_join(transform(spans, s -> concat_ws(':', s.kind, s.start, s.end)), ',') AS spans", "n_entropy"
    )
