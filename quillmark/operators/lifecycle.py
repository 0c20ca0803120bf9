"""From raw texts to chunk records: pages, sections and packed bodies, each chunk with the stretch of the raw text that it was made from."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import text as T
from . import chunking as C

#: Characters that packing may leave out or put in between sentences.
_LOOSE = re.compile(r"[\s.!?۔؟。]+")
_ENDS = re.compile(r"[.!?][\"')\]]{0,20}\Z")


class Mapped:
    """A text, and for each of its characters the stretch [start, end) of the raw text that it stands for. Edits keep the map, so they compose."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None) -> None:
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = np.arange(1, len(text) + 1) if end is None else end

    def __getitem__(self, s: slice) -> Mapped:
        return Mapped(self.text[s], self.start[s], self.end[s])

    def stripped(self) -> Mapped:
        lead = len(self.text) - len(self.text.lstrip())
        return self[lead : lead + len(self.text.strip())]

    def sub(self, pattern: str, to: str, when: Callable[[re.Match], bool] = lambda m: True) -> Mapped:
        """re.sub; what is put in stands for all that it replaces."""
        texts, starts, ends, at = [], [], [], 0
        for m in re.finditer(pattern, self.text):
            if not when(m) or (m.start() == m.end()):
                continue
            new = m.expand(to)
            texts += [self.text[at : m.start()], new]
            starts += [self.start[at : m.start()], np.full(len(new), self.start[m.start()])]
            ends += [self.end[at : m.start()], np.full(len(new), self.end[m.end() - 1])]
            at = m.end()
        if not texts:
            return self
        return Mapped("".join([*texts, self.text[at:]]), np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]]))

    @staticmethod
    def joined(parts: list[Mapped], glue: str = "\n") -> Mapped:
        """Parts with the glue between them, which stands for what lies between."""
        texts, starts, ends = [], [], []
        for i, p in enumerate(parts):
            if i:
                texts.append(glue)
                starts.append(np.full(len(glue), parts[i - 1].end[-1])), ends.append(np.full(len(glue), p.start[0]))
            texts.append(p.text), starts.append(p.start), ends.append(p.end)
        return Mapped("".join(texts), np.concatenate(starts), np.concatenate(ends)) if parts else Mapped("")


def unwrapped(x: Mapped) -> Mapped:
    """What `text.unwrap_lines` does, with the map kept."""
    x = x.sub(r"\r\n?", "\n").sub(r"(\w)-\n(\w)", r"\1\2").sub(r"[ \t]+", " ").sub(r"(?m)^[ \t]+|[ \t]+$", "")
    x = x.sub(r"(?<!\n)\n(?=[a-z])", " ", lambda m: not _ENDS.search(m.string[max(0, m.start() - 21) : m.start()]))
    return x.sub(r"\n{3,}", "\n\n").stripped()


def pages(x: Mapped, fence: str = C.PAGE) -> list[tuple[int, Mapped]]:
    """(page, text) of the parts between fences, numbered by the fence's first group, by the last one that has a number, or 1."""
    out, page, at = [], 1, 0
    cuts = list(re.finditer(f"(?m){fence}", x.text))
    for i, m in enumerate([*cuts, None]):
        part = x[at : m.start() if m else len(x.text)]
        if part.text.strip():
            out.append((page, part.stripped()))
        if m:
            number = m.group(1) if m.re.groups else None
            page, at = int(number) if number and number.isdigit() and int(number) < 1 << 31 else page, m.end()
    return out


def sections(x: Mapped, headers: tuple[str, ...] = ()) -> list[tuple[str, float, Mapped]]:
    """(title, confidence, body) as in `chunking.sections`: 1 for a given heading, 0.8 for one by shape, 0.5 before any, 0 for a text of headings alone."""
    out, title, sure, held, at = [], "Introduction", 0.5, [], 0
    for line in [*x.text.split("\n"), None]:
        part = None if line is None else x[at : at + len(line)].stripped()
        at += 0 if line is None else len(line) + 1
        if part is not None and not part.text:
            continue
        given = part is not None and any(re.search(h, part.text) for h in headers)
        shaped = part is not None and any(re.search(p, part.text) for p in (C.NUMBERED, C.TITLE)) or part is not None and re.search(C.CAPITALS, part.text) and len(part.text.split()) >= 2
        if part is None or given or shaped:
            if held:
                out.append((title, sure, Mapped.joined(held)))
            if part is not None:
                title, sure, held = part.text, 1.0 if given else 0.8, []
        else:
            held.append(part)
    return out or ([("Introduction", 0.0, x.stripped())] if x.text.strip() else [])


def located(body: Mapped, chunks: list[str]) -> list[tuple[int, int, bool]]:
    """For each chunk of a body the raw stretch it covers, and whether the stretch has the chunk's characters in its order, white space and sentence ends apart.

    Chunks are looked for from the start of the one before, as they overlap, and then in front of it, as a sentence cut at words may come again whole. A chunk that holds its neighbour's overlap twice covers from its first to its last words."""
    keep = np.ones(len(body.text), bool)
    for m in _LOOSE.finditer(body.text):
        keep[m.start() : m.end()] = False
    places = np.flatnonzero(keep)
    bare = _LOOSE.sub("", body.text)
    out, at = [], 0
    for c in chunks:
        want = _LOOSE.sub("", c)
        if not want:
            out.append((int(body.start[0]), int(body.end[-1]), False))
            continue
        found, n = bare.find(want, at), len(want)
        found = found if found >= 0 else bare.rfind(want, 0, at + n)
        whole = found >= 0
        if not whole:
            found = max(0, bare.find(want[:40], at))
            last = bare.find(want[-40:], found)
            n = (last + len(want[-40:]) if last >= 0 else len(bare)) - found
        at = found
        out.append((int(body.start[places[found]]), int(body.end[places[found + n - 1]]), whole))
    return out


def chunk_records(
    df: DataFrame, key: str, text: str = "text", strategy: str = "sentence", max_tokens: int = 800, overlap: int = 240, keep: int = 1, least: int = 100, headers: tuple[str, ...] = (), fence: str = C.PAGE,
    workspace: str | None = None, product: str = "p", version: str = "unknown", run: str | None = None, extractor: str = "1.0", chunker: str = "1.0", model: str | None = None, source_uri: str | None = None, at: str | None = None,
) -> DataFrame:
    """A record for each chunk of each section of each page of each row's text, with all fields of the contract.

    The raw text is unwrapped, cut at page fences and headings, and packed; every step keeps the map to the raw text, so that raw_start and raw_end (characters, end exclusive) say what a chunk was made
    from, raw_text is that stretch, and `whole` that it has the chunk's characters in order. Chunks are numbered inside their section; several sections of one name on a page are told apart by
    section_index. Row by row, with no shuffle. Null and empty texts, and texts of page fences alone, have no chunk. at: the time of extraction, which is no one else's to choose.
    """
    size, hard = C.limits(max_tokens, overlap)
    cut, kind = C.STRATEGIES[strategy], dict(df.dtypes)[key]

    def one(raw: str) -> Iterator[tuple]:
        for page, part in pages(unwrapped(Mapped(raw)), fence):
            for nth, (title, sure, body) in enumerate(sections(part, headers)):
                chunks = [c for c in C.merge_tiny(C.merge_headings(cut(body.text, size, keep, hard)), least) if c.strip()]
                for i, (c, (a, b, whole)) in enumerate(zip(chunks, located(body, chunks), strict=True)):
                    yield page, nth, title, sure, i, len(chunks), c, a, b, whole, raw[a:b]

    fields = [("page", pa.int32(), "int"), ("section_index", pa.int32(), "int"), ("section_raw", pa.string(), "string"), ("section_confidence", pa.float64(), "double"), ("chunk_index", pa.int32(), "int"), ("chunk_of", pa.int32(), "int"),
              ("text", pa.string(), "string"), ("raw_start", pa.int64(), "bigint"), ("raw_end", pa.int64(), "bigint"), ("whole", pa.bool_(), "boolean"), ("raw_text", pa.string(), "string")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, t in enumerate(b.column(1).to_pylist()) if t for r in one(t)]
            cols = list(zip(*rows, strict=True)) or [()] * (len(fields) + 1)
            of = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(2).take(of), *(pa.array(c, t) for c, (_, t, _) in zip(cols[1:], fields, strict=True))], [key, "source_checksum", *[n for n, _, _ in fields]])

    schema = ", ".join([f"`{key}` {kind}", "source_checksum string", *[f"{n} {t}" for n, _, t in fields]])
    raw = F.col(text).cast("string")
    x = df.select(key, raw, F.sha2(raw, 256)).mapInArrow(work, schema).withColumn("token_est", T.token_estimate(F.col("text"))).filter("token_est > 0")
    stem, name, now = F.concat(F.lit("doc_"), F.col(key).cast("string")), C.canonical(F.col("section_raw")), F.lit(at).cast("string")
    return x.select(
        F.concat(stem, F.lit("_p"), F.col("page").cast("string"), F.lit("_s"), name, F.lit("_c"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col(key).alias("doc_id"), stem.alias("file_stem"), "page", name.alias("section"),
        name.alias("section_id"), name.alias("field_name"), "section_index", "section_raw", "section_confidence", "chunk_index", "chunk_of", "text", F.col("text").alias("cleaned_text"), "raw_text", "raw_start", "raw_end", "whole", "token_est",
        F.sha2("text", 256).alias("cleaned_text_hash"), "source_checksum", classify.audience(F.col("text"), F.col("section_raw")).alias("audience"), F.lit(product).alias("product_id"), F.lit(product).alias("index_scope"),
        stem.alias("doc_scope"), name.alias("field_scope"), F.lit(workspace).cast("string").alias("workspace_id"), F.lit(version).alias("version"), F.lit(run).cast("string").alias("pipeline_run_id"), F.lit(source_uri).cast("string").alias("source_uri"),
        F.lit(extractor).alias("extractor_version"), F.lit(chunker).alias("chunker_version"), F.lit(model).cast("string").alias("embedding_model_id"), now.alias("extraction_timestamp"), now.alias("created_at"),
    )
