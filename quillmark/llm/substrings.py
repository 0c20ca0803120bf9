"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bit_table, distinct_rows, is_set, small, table, written

GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)
#: The five highest bits of the 32-bit hash: a cut in 32 places, after the last 32 bytes.
MASK = np.uint32(0xF8000000)
#: In place of the hash where no cut may be, inside of a character.
NEVER = 0xFFFFFFFF
#: Most bits of the table of repeated chunks that is broadcast (32 MB), whatever the size of the corpus.
BITS = 1 << 28


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the rolling hash h = 2h + GEAR[byte] mod 2**32, for all bytes at once.

    Only the last 32 bytes are in h, and sums over 1, 2, 4, 8, 16 and 32 bytes are made from each other.
    """
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        add = h[:-s] << np.uint32(s)
        h = h.copy()
        h[s:] += add
    return h


def period_cuts(h: np.ndarray, most: int) -> list[int]:
    """Ends in a part without a cut where its bytes repeat with a period up to `most`: behind the least hash of each period.

    The last 32 bytes occurred before if their hash did, so the ends depend on the repeated bytes alone and not on where a run starts.
    """
    values = h.tolist()
    out, last = [], {}
    for i, x in enumerate(values):
        if i - last.get(x, -most - 1) <= most and x == min(values[last[x] + 1 : i + 1]):
            out.append(i + 1)
        last[x] = i
    return out


def repeating(h: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of the parts h[start:stop] hold a hash twice, by one sort of (part, hash) for all of them; in most texts none does."""
    if not len(starts):
        return starts
    sizes = stops - starts
    part = np.repeat(np.arange(len(starts), dtype=np.uint64), sizes)
    values = h[np.arange(sizes.sum()) + np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)]
    keys = np.sort(((part << np.uint64(32)) | values)[values != NEVER])
    return np.unique(keys[1:][keys[1:] == keys[:-1]] >> np.uint64(32)).astype(np.int64)


def cuts(data: np.ndarray, least: int, most: int) -> list[int]:
    """Ends of the chunks: behind a byte whose hash has MASK's bits 0, from `least` bytes on, and never inside a character.

    Where no such byte comes, runs of repeated bytes are cut by their period, and what is still longer than `most` bytes behind the byte of least hash."""
    n = len(data)
    whole = np.append((data[1:] & 0xC0) != 0x80, True) if n else np.empty(0, bool)
    h = gear(data)
    places = np.flatnonzero(((h & MASK) == 0) & whole) + 1
    ends = places.tolist()
    h = np.where(whole, h, np.uint32(NEVER))
    edges = np.concatenate(([0], places, [n]))
    long = np.flatnonzero(np.diff(edges) > 32 + least)
    starts, stops = edges[long], np.where(edges[long + 1] < n, edges[long + 1] - 1, n)
    for i in repeating(h, starts, stops).tolist():
        a, b = int(starts[i]), int(stops[i])
        ends += [a + e for e in period_cuts(h[a:b], most) if whole[a + e - 1]]
    out, start = [], 0
    for end in [*sorted(ends), n]:
        while end - start > most:
            start += least + int(h[start + least - 1 : start + most].argmin())
            out.append(start)
        if end - start >= least or (end == n and start < n):
            out.append(end)
            start = end
    return out


def _cut(x: pa.Array, least: int, most: int) -> Iterator[tuple[bytes, np.ndarray, list[int], list[bytes]]]:
    """For each text its bytes, the same as an array, the ends of its chunks, and their 128-bit digests."""
    for t in x.cast(pa.binary()):
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        data = np.frombuffer(raw, np.uint8)
        stop = cuts(data, least, most)
        yield raw, data, stop, [xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip([0, *stop], stop, strict=False)]


def chunk_keys(df: DataFrame, text: str, least: int, most: int) -> DataFrame:
    """h, n: the second half of each chunk's digest, and in how many places of a batch it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests = [d for *_, ds in _cut(b.column(0), least, most) for d in ds]
            h, n = np.unique(np.frombuffer(b"".join(digests), np.int64)[1::2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int32))], ["h", "n"])

    return arrow_map(df.select(F.col(text).cast("string").alias("_x")), run, "h bigint, n int")


def chunks(df: DataFrame, id_col: str, text: str, least: int, most: int, keys: Broadcast) -> DataFrame:
    """_d (id), _t (key of the row), c of each text with chunks whose keys may be in the table of bits: these chunks with start, end (code points), at, size (bytes), hi, lo (128-bit digest)."""
    id_type = dict(df.dtypes)[id_col]
    chunk = "array<struct<start:int,end:int,at:int,size:int,hi:bigint,lo:bigint>>"
    fields = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("at", pa.int32()), ("size", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = keys.value
        for b in batches:
            starts, ends, begins, stops, digests, counts = [], [], [], [], [], []
            for raw, data, stop, found in _cut(b.column(2), least, most):
                at = np.array(stop, np.int64)
                if not raw.isascii():
                    at = np.cumsum((data & 0xC0) != 0x80)[at - 1]
                at = at.tolist()
                starts += [0, *at[:-1]] if at else []
                ends += at
                begins += [0, *stop[:-1]] if stop else []
                stops += stop
                digests += found
                counts.append(len(stop))
            two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            keep = is_set(bits, two[:, 1])
            left = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
            some = pa.array(left > 0)
            begins, stops = np.array(begins, np.int64), np.array(stops, np.int64)
            parts = [pa.array(np.array(x, np.int32)[keep]) for x in (starts, ends, begins, stops - begins)] + [pa.array(two[keep, i]) for i in (0, 1)]
            offsets = pa.array(np.concatenate(([0], np.cumsum(left[left > 0]))), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(some), b.column(1).filter(some), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(fields.value_type)))], ["_d", "_t", "c"])

    return arrow_map(df.select(F.col(id_col).alias("_d"), F.xxhash64(F.col(id_col), F.col(text)).alias("_t"), F.col(text).cast("string").alias("_x")), run, f"_d {id_type}, _t bigint, c {chunk}")


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def whole_words(context: bytes, n: int, back: bool) -> tuple[int, int]:
    """The most bytes, up to n, of a context after which neither a character nor an ASCII word is cut, and their code points."""
    word = lambda i: i < len(context) and context[i] < 0x80 and chr(context[i]).isalnum()
    inside = lambda i: 0 <= i < len(context) and context[i] & 0xC0 == 0x80
    while n and (inside(n - 1 if back else n) or (word(n - 1) and word(n))):
        n -= 1
    return n, sum(x & 0xC0 != 0x80 for x in context[:n])


def contexts(docs: DataFrame, reach: int) -> DataFrame:
    """hi, lo, back, ctx, edge, _t, pos (code points), byte: up to `reach` bytes on the marked sides of each place in p; those in front reversed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, x, places in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                raw = x.as_buffer().to_pybytes()
                for p in places:
                    if p["ml"]:
                        stop, a = p["at"], max(0, p["at"] - reach)
                        while a < stop and raw[a] & 0xC0 == 0x80:
                            a += 1
                        rows.append((p["hi"], p["lo"], True, raw[a:stop][::-1], p["left"], t, p["start"], stop))
                    if p["mr"]:
                        a = p["at"] + p["size"]
                        stop = min(len(raw), a + reach)
                        while a < stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                            stop -= 1
                        rows.append((p["hi"], p["lo"], False, raw[a:stop], p["right"], t, p["end"], a))
            rows = [r for r in rows if r[3]]
            cols = zip(*rows, strict=True) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["hi", "lo", "back", "ctx", "edge", "_t", "pos", "byte"])

    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.bool_(), pa.int64(), pa.int32(), pa.int32()]
    return arrow_map(docs, run, "hi bigint, lo bigint, back boolean, ctx binary, edge boolean, _t bigint, pos int, byte int")


def shared_lengths(every: DataFrame) -> DataFrame:
    """hi, lo, back, h, bytes, points: how much of each context some other place of its chunk shares.

    Contexts are dealt by ranges and sorted, so the longest common prefix is that with a neighbour, and no chunk's places are in one task,
    however many: equal contexts are dealt by their places. Contexts on either side of a range's end are compared on the driver: two for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, best, first = None, 0, True
        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = 0
                if last is not None:
                    if last[:4] == r[:4]:
                        best = len(r[3]) if last[5] != r[5] else best
                        continue
                    n = common(last[3], r[3]) if last[:3] == r[:3] else 0
                    out.append((*last[:3], last[4], *whole_words(last[3], max(best, n), last[2]), part, last[3] if first else None))
                    first = False
                last, best = r, n
            yield _lengths(out)
        if last is not None:
            yield _lengths([(*last[:3], last[4], *whole_words(last[3], best, last[2]), part, last[3])])

    order = ["hi", "lo", "back", "ctx", "place"]
    dealt = every.select(*order[:4], "h", "place").repartitionByRange(*order).sortWithinPartitions(*order)
    out = written(arrow_map(dealt, run, "hi bigint, lo bigint, back boolean, h bigint, bytes int, points int, part int, ctx binary"), "lengths")
    ends = sorted((tuple(r) for r in out.filter("ctx IS NOT NULL").collect()), key=lambda r: (r[6], r[0], r[1], r[2], r[7]))
    more = []
    for a, b in zip(ends, ends[1:], strict=False):
        if a[6] != b[6] and a[:3] == b[:3]:
            n = common(a[7], b[7])
            more += [(*x[:4], *whole_words(x[7], n, x[2])) for x in (a, b)]
    found = out.drop("part", "ctx")
    if more:
        found = found.union(every.sparkSession.createDataFrame(more, found.schema)).groupBy("hi", "lo", "back", "h").agg(F.max("bytes").alias("bytes"), F.max("points").alias("points"))
    return found.filter("bytes > 0")


def _lengths(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    cols = zip(*rows, strict=True) if rows else [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["hi", "lo", "back", "h", "bytes", "points", "part", "ctx"])


def extensions(df: DataFrame, id_col: str, text: str, texts: DataFrame, reach: int) -> DataFrame:
    """_t, more: what lies beside the ends of each text's repeated chunks and also beside the same chunk elsewhere, in whole words.

    Only chunks that end a stretch somewhere are looked at, in all their places. A chunk that lies wholly in a common stretch behind a common chunk
    is common itself, so `reach` need not be more than a chunk's greatest size there; in front it bounds what is found.
    """
    x = texts.selectExpr("_t", """inline(transform(c, (e, i) -> named_struct('start', e.start, 'end', e.end, 'at', e.at, 'size', e.size, 'hi', e.hi, 'lo', e.lo,
        'left', e.start > 0 AND coalesce(get(c, i - 1).end, -1) <> e.start, 'right', coalesce(get(c, i + 1).start, -1) <> e.end)))""")
    marks = x.filter("`left` OR `right`").groupBy("hi", "lo").agg(F.bool_or("left").alias("ml"), F.bool_or("right").alias("mr"))
    where = x.join(small(marks), ["hi", "lo"]).groupBy("_t").agg(F.collect_list(F.struct("start", "end", "at", "size", "hi", "lo", "left", "right", "ml", "mr")).alias("p"))
    docs = df.select(F.xxhash64(F.col(id_col), F.col(text)).alias("_t"), F.col(text).cast("string").alias("_x")).join(where.hint("shuffle_hash"), "_t")
    every = written(contexts(docs, reach).withColumn("h", F.xxhash64("ctx")).withColumn("place", F.xxhash64("_t", "pos")), "contexts", compression="zstd")
    found = every.filter("edge").join(small(shared_lengths(every)), ["hi", "lo", "back", "h"])
    piece = """named_struct('start', if(back, pos - points, pos), 'end', if(back, pos, pos + points), 'at', if(back, byte - bytes, byte), 'size', bytes)"""
    return found.groupBy("_t").agg(F.collect_set(F.expr(piece)).alias("more"))


def repeated_chunks(df: DataFrame, id_col: str, text: str, least: int, most: int, bits: int = BITS) -> DataFrame:
    """_d, _t, c of each text with repeated chunks: c are those chunks in order, with n (their places) and first_id (their least id, null if all are null).

    Most chunks are in one place. Half of a digest is counted first, and what isn't in the table of bits of those found twice is never shuffled; the others are counted exactly."""
    keys = written(chunk_keys(df, text, least, most).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "keys")
    every = written(chunks(df, id_col, text, least, most, bit_table(keys, bits)), "places", compression="zstd").select("_d", "_t", F.inline("c"))
    often = every.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min("_d").alias("first_id"), F.min("_t").alias("t0"), F.max("_t").alias("t1"), F.min("start").alias("s0"), F.max("start").alias("s1"))
    often = written(often.filter("n > 1 AND (t0 <> t1 OR s0 <> s1)").select("hi", "lo", "n", "first_id"), "often")  # as a table, so that Spark can split the join at a chunk of very many places
    places = every.join(often.hint("merge"), ["hi", "lo"]).select("_d", "_t", "start", "end", "at", "size", "n", "first_id", "hi", "lo")
    return places.repartition("_t").groupBy("_d", "_t").agg(F.array_sort(F.collect_set(F.struct("start", "end", "at", "size", "n", "first_id", "hi", "lo"))).alias("c"))  # one text's chunks


def owned_by_others(texts: DataFrame) -> DataFrame:
    """texts with only those of their chunks that another text owns: the one with the least id that holds the chunk, of several the one with the least key. Without such chunks a text goes."""
    x = texts.select("_d", "_t", F.inline("c"))
    holds = x.filter("_d <=> first_id").groupBy("hi", "lo").agg(F.min("_t").alias("owner"))
    other = x.join(holds, ["hi", "lo"]).filter("owner <> _t")
    return other.groupBy("_d", "_t").agg(F.array_sort(F.collect_list(F.struct("start", "end", "at", "size", "n", "first_id", "hi", "lo"))).alias("c"))


def stretches(texts: DataFrame, id_type: str) -> DataFrame:
    """_d, _t, start, end, chunks, bytes, first, n: neighbours in c, and those that overlap, as one stretch."""
    empty = f"cast(array() AS array<struct<start:int,end:int,chunks:int,at:int,stop:int,first:{id_type},n:bigint>>)"
    merged = f"""aggregate(transform(c, x -> named_struct('start', x.start, 'end', x.end, 'chunks', int(x.hi IS NOT NULL), 'at', x.at, 'stop', x.at + x.size,
        'first', if(x.hi IS NULL, null, x.first_id), 'n', if(x.hi IS NULL, null, x.n))), {empty}, (a, x) -> CASE
        WHEN size(a) > 0 AND a[size(a) - 1].end >= x.start
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, 'end', greatest(a[size(a) - 1].end, x.end), 'chunks', a[size(a) - 1].chunks + x.chunks,
            'at', a[size(a) - 1].at, 'stop', greatest(a[size(a) - 1].stop, x.stop), 'first', least(a[size(a) - 1].first, x.first), 'n', greatest(a[size(a) - 1].n, x.n))))
        ELSE concat(a, array(x)) END)"""
    return texts.select("_d", "_t", F.inline(F.expr(merged))).withColumn("bytes", F.expr("stop - at"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 24, most: int = 256, min_bytes: int = 128, whole: bool = True) -> DataFrame:
    """id, _t, start, end (code points), n_chunks, n_bytes, first_id, n_copies of each stretch of a text that also occurs elsewhere.

    Texts are cut where the gear hash of the last 32 bytes says so, so an insertion moves no cut but those near it. Chunks with one
    digest in two or more places are repeated; neighbours in a text make a stretch. Its ends are moved outwards by whole words as far as the text
    agrees with any other place of the chunk there (`extensions`; not with whole=False, nor if there is no least length to reach), stretches that then
    meet are one, and those of min_bytes or more are returned. first_id is the least id
    that holds one of its chunks, n_copies the largest number of places of one of them. Numbers by digest are summed in the tasks
    before the shuffle, so a passage in a third of all texts is one row per task; Spark splits the join of its places.

    Nulls: a null text counts as '' and has no chunks; a row with a null id counts as a place, with first_id null only if all have null ids.
    Rows equal in id and text are one place. An empty table gives an empty result. Other columns have no effect.
    """
    df = distinct_rows(df, id_col, text)
    texts = repeated_chunks(df, id_col, text, least, most)
    if whole and min_bytes > 0:
        texts = written(texts, "chunks", compression="zstd")
        texts = texts.join(extensions(df, id_col, text, texts, most).hint("shuffle_hash"), "_t", "left").withColumn("c", F.expr("""if(more IS NULL, c, array_sort(concat(c, transform(more, m -> named_struct('start', m.start,
            'end', m.end, 'at', m.at, 'size', m.size, 'n', c[0].n, 'first_id', c[0].first_id, 'hi', cast(null AS bigint), 'lo', cast(null AS bigint))))))"""))
    out = stretches(texts, dict(df.dtypes)[id_col])
    return out.filter(F.col("bytes") >= min_bytes).select(F.col("_d").alias(id_col), "_t", "start", "end", F.col("chunks").alias("n_chunks"), F.col("bytes").alias("n_bytes"), F.col("first").alias("first_id"), F.col("n").alias("n_copies"))


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 24, most: int = 256, min_bytes: int = 128) -> DataFrame:
    """df with its texts cut: each repeated chunk stays in one text, its owner, and goes from the others where the chunks to go make a stretch of min_bytes.

    The owner is the text with the least id that holds the chunk, of texts under one id the one with the least hash; it keeps all of the chunk's places. It is found for each chunk by
    itself, as neighbours in one text may have been first in different ones, so nothing is lost: every chunk is still whole in its owner.
    Stretches are not extended here, as the words beside a chunk may be shared with other texts than the owner.

    Nulls: a null text stays null; rows with a null id own a chunk only if all its holders have null ids. Rows equal in id and text are cut alike. An empty table
    gives an empty result. Rows and columns are those of df; its columns named _q_s or _q_t are refused.
    """
    if {"_q_s", "_q_t"} & set(df.columns):
        raise ValueError("columns named _q_s and _q_t are taken")
    texts = written(repeated_chunks(distinct_rows(df, id_col, text), id_col, text, least, most), "chunks")
    spans = stretches(owned_by_others(texts), dict(df.dtypes)[id_col]).filter(F.col("bytes") >= min_bytes)
    spans = written(spans.groupBy(F.col("_t").alias("_q_t")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_q_s")), "spans")
    x = df.withColumn("_q_t", F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`"))).join(small(spans), "_q_t", "left")
    kept = f"""concat(aggregate(_q_s, named_struct('p', 0, 's', ''), (a, s) -> named_struct('p', s.end, 's', concat(a.s, substring(`{text}`, a.p + 1, s.start - a.p))), a -> a.s),
        substring(`{text}`, element_at(_q_s, -1).end + 1))"""
    return x.withColumn(text, F.when(F.col("_q_s").isNull(), F.col(text)).otherwise(F.expr(kept))).select(*[F.col(f"`{c}`") for c in df.columns])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated stretches in all documents."""
    return repeated_spans(table(spark, sf_dir, "documents")).drop("_t")
