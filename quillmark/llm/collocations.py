"""Phrases of two to four words that stick together: level-wise counts, cuts scored from the counts, phrases inside longer ones dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, small, table, written
from .selection import top_rows

LEAST, LONGEST, TOP, INSIDE = 30, 4, 2000, 80
#: Most bits of the table of frequent phrases that is broadcast (16 MB), whatever the size of the corpus.
BITS = 1 << 27
#: A-Z are lower-cased, and all signs that end a piece become \\n.
_SIGNS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Stands between pieces; no byte of UTF-8.
_BREAK = b"\xff"
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def pieces(text: bytes) -> bytes:
    """The text with a break between pieces; white space left in it separates words."""
    return text.translate(_SIGNS).replace(b"\n", b" " + _BREAK + b" ")


def frequent_bits(level: DataFrame, most: int = BITS) -> Broadcast:
    """A table of bits in which those of each phrase's hash are set, broadcast. It has 32 bits for each phrase, and never more than `most`.

    A phrase that isn't frequent may find its bit set, which costs a needless count and changes no result. Rows (word, its 64 bits) are summed by Spark; at most
    most / 64 of them reach the driver."""
    n = level.count()
    bits = min(most, max(1 << 16, 1 << (32 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_hash(lang, phrase.split(b" ")) for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(got, np.uint64).view(np.int64))], ["h"])

    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    rows = arrow_map(level.select("lang", "phrase"), run, "h bigint").groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return level.sparkSession.sparkContext.broadcast(out)


def _hash(lang: str, words: list[bytes]) -> int:
    """The hash of one phrase, as `_counted` makes it for all places of a text."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    h = np.array([xxhash.xxh3_64_intdigest(words[0], seed)], np.uint64)
    for w in words[1:]:
        h = _mixed(h * _P + np.uint64(xxhash.xxh3_64_intdigest(w, seed)))
    return int(h[0])


def _is_set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) == 1


def _counted(lang: str, text: bytes, k: int, bits: np.ndarray | None) -> pa.RecordBatch:
    """lang, phrase, n of the phrases of k words in texts with breaks; with bits, of those whose first and last k - 1 words are in it. Words are numbers inside a batch, so counts don't rest on hashes."""
    words = pa.array(text.split() + [_BREAK], pa.binary()).dictionary_encode()
    ids, names = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
    end = names.index(_BREAK)
    at = ids != end
    if bits is not None:
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        own = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in names), np.uint64, len(names))[ids]
        h = own
        for j in range(1, k - 1):
            at, h = at[:-1] & (ids[j:] != end), _mixed(h[:-1] * _P + own[j:])
        known = _is_set(bits, h) & at  # phrases of k - 1 words; two of them make one of k
        at = known[:-1] & known[1:]
        del own, h, known
    else:
        for j in range(1, k):
            at = at[:-1] & (ids[j:] != end)
    at = np.flatnonzero(at)
    code = ids[at]
    for j in range(1, k):
        code = np.unique(code, return_inverse=True)[1] * len(names) + ids[at + j]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    at = at[first]
    phrases = [b" ".join(p) for p in zip(*([names[i] for i in ids[at + j]] for j in range(k)), strict=True)]
    if k == 1:  # the words of a language stand under an empty phrase
        phrases, n = [*phrases, b""], np.append(n, n.sum())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def phrase_counts(df: DataFrame, k: int, frequent: Broadcast | None = None, most: int = 4 << 20) -> DataFrame:
    """lang, phrase, f of the phrases of k words in all texts of df (lang, text; none null); with `frequent`, of those whose overlapping parts are frequent. The empty phrase of level 1 stands for all words.

    Sums are made over some `most` bytes of a language at a time, then by task, then shuffled. Long texts are cut between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if frequent is None else frequent.value
        held: dict[str, list[bytes]] = {}
        size = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                t, start = pieces(text.as_buffer().to_pybytes()), 0
                while start < len(t):
                    end = t.find(_BREAK, start + most) if len(t) - start > most else -1
                    part = t[start : end if end >= 0 else len(t)]
                    start += len(part)
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= most:
                        for x, texts in held.items():
                            yield _counted(x, (b" " + _BREAK + b" ").join(texts), k, bits)
                        held, size = {}, 0
        for x, texts in held.items():
            yield _counted(x, (b" " + _BREAK + b" ").join(texts), k, bits)

    found = arrow_map(df.select("lang", "text"), run, "lang string, phrase binary, n bigint")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).withColumn("phrase", F.col("phrase").cast("string"))


def levels(df: DataFrame, least: int, longest: int, bits: int) -> tuple[DataFrame, list[DataFrame]]:
    """n of each lang, and the tables of frequent phrases (lang, phrase, f) of 1 to `longest` words. A pass over the texts makes each level from the bits of the one before."""
    found = [written(phrase_counts(df, 1).filter(f"f >= {least} OR phrase = ''"), "level1")]
    total = found[0].filter("phrase = ''").select("lang", F.col("f").alias("n"))
    found[0] = found[0].filter("phrase <> ''")
    for k in range(2, longest + 1):
        known = frequent_bits(found[-1], bits)
        found.append(written(phrase_counts(df, k, known).filter(f"f >= {least}"), f"level{k}"))
        known.unpersist()
    return total, found


def scored(tables: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r, score of each phrase of two or more words at its lowest cut; of equal scores, the cut after the fewest words."""
    every = tables[0].select("lang", "phrase", "f")
    for t in tables[1:]:
        every = every.unionByName(t.select("lang", "phrase", "f"))
    whole = every.filter("phrase LIKE '% %'").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.size("w")), " ").alias("right")))
    cuts = whole.select("lang", "phrase", "a", F.inline(cut))
    part = lambda side, n: small(every).select("lang", F.col("phrase").alias(side), F.col("f").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(20,0)) * 2000000) div cast(l + r as decimal(20,0))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def held_inside(tables: list[DataFrame], percent: int) -> DataFrame:
    """lang, phrase of the phrases of two or more words that lie inside a longer frequent one with at least percent % of their count."""
    subs = None
    for k, t in enumerate(tables[2:], 3):
        inside = [F.array_join(F.slice("w", i, n), " ") for n in range(2, k) for i in range(1, k - n + 2)]
        x = t.select("lang", "f", F.split("phrase", " ").alias("w")).select("lang", F.explode(F.array(*inside)).alias("phrase"), "f")
        subs = x if subs is None else subs.unionByName(x)
    longer = subs.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    own = tables[1].select("lang", "phrase", "f")
    for t in tables[2:]:
        own = own.unionByName(t.select("lang", "phrase", "f"))
    return own.join(longer, ["lang", "phrase"]).filter(100 * F.col("longer") >= percent * F.col("f")).select("lang", "phrase")


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, longest: int = LONGEST, inside: int = INSIDE, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of two to `longest` words.

    A phrase is counted if it occurs `least` times or more inside pieces, the runs of text between signs and line ends. Level k counts only phrases whose first and
    last k - 1 words are frequent (`frequent_bits`, of bounded size at any scale); as a phrase is never more frequent than its parts, that loses nothing. A phrase's score is that of its weakest
    cut, 2,000,000 a / (l + r) rounded down, from the level tables. Phrases that a longer one holds in `inside` % of their places or more are dropped. The first rows come from `top_rows`.

    Nulls: a null text is empty, a null language is `und`. Repeated rows count each. A language without frequent phrases gives no rows, and neither does an
    empty table. Other columns have no effect, whatever their names.
    """
    x = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    total, tables = levels(x, least, longest, bits)
    found = scored(tables)
    if longest > 2:
        found = found.join(held_inside(tables, inside), ["lang", "phrase"], "left_anti")
    first = top_rows(found, ["lang"], [("score", 21), ("a", 62)], "phrase", top, 4 * top)
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents, by language."""
    return collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, unnest(range(1, 5)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, a, c.k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, unnest(range(1, len(w))) AS u(k)) c JOIN f l ON l.lang = c.lang AND l.phrase = x JOIN f r ON r.lang = c.lang AND r.phrase = y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
subs AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS m FROM c, unnest(range(2, len(w))) AS x(n), unnest(range(1, len(w) - n + 2)) AS y(i) GROUP BY ALL),
left_ AS (SELECT best.* FROM best LEFT JOIN subs USING (lang, phrase) WHERE m IS NULL OR 100 * m < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM left_) JOIN n USING (lang) WHERE rank <= 2000
"""
