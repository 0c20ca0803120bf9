"""Training-order materialisation: token sequences in the order of a keyed permutation, in shards of fixed stride."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, key60, running, shared_dir, small, table, written
from .tokens import RANKS, encoder, end_of, vocabulary

ROUNDS = 6
KEY = 20240229


def feistel(i: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The place of each i of [0, n) under a keyed permutation of [0, n).

    A balanced Feistel network permutes the least [0, 4**h) that holds n; who lands at n or beyond walks on through the network until he is inside,
    four steps on average at most.
    """
    h = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(h)) - 1)
    keys = np.random.Generator(np.random.PCG64(key)).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> h, x & low
        for k in keys:
            f = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(31)) & low)
        return (a << h) | b

    x = once(np.asarray(i, np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def materialise(df: DataFrame, path: str, seq_len: int = 512, shard_bytes: int = 128 << 20, id_col: str = "doc_id", text: str = "text", ranks: str = RANKS, key: int = KEY) -> DataFrame:
    """Writes all of df's texts as token sequences under path and returns a row for each: id, seq_no, slot, shard, offset, n_tokens, crc32.

    A text's ids, with an end id behind them that no token of the vocabulary has, are cut into sequences of seq_len, the last one filled up with end ids; each is seq_len little-endian
    numbers of 16 bits, or 32 if the vocabulary needs them. A text can't have more tokens than bytes, so before any text is tokenised each has a range of
    ceil((bytes + 1) / seq_len) places, in a seeded order of the ids. `feistel` permutes all places; a sequence's slot is the rank of its
    place among the places in use, which is as random an order. Places are dealt to range partitions, each of which is sorted
    and written as shards: record r of a shard is at r * stride. A shard has room for shard_bytes and is as full as its places are in use, a third or so.
    So texts are tokenised once, ids are shuffled once, and no copy is kept beside the shards. A shard is written as a stream under a name of its own and then renamed,
    so a task that runs again writes the same file again. The index, a small table under path/index, comes last: shard, first_slot, rows, seq_len, width,
    end; a folder without it isn't complete, and `read_from` needs nothing else. Texts meet their places in a broadcast of up to a million rows, beyond that in one shuffle.

    Nulls: null and empty texts have no sequence; a null id counts as '' in the order and is kept. Rows that repeat id and text are each written, their copies
    dealt to tasks by thousands. An empty table writes an empty index and gives an empty result. Other columns have no effect.
    """
    spark = df.sparkSession
    data = vocabulary(spark, ranks)
    end = end_of(data.value)
    kind = np.dtype("<u2" if end < 1 << 16 else "<u4")
    stride = seq_len * kind.itemsize
    per_shard = max(1, shard_bytes // stride)
    id_type = dict(df.dtypes)[id_col]
    amount = F.coalesce(F.octet_length(F.col(text)), F.lit(0))
    row = F.xxhash64(F.col(id_col), F.col(text))
    x = df.select(F.col(id_col).alias("_d"), F.col(text).cast("string").alias("_x"), row.alias("_t")).filter(amount > 0)
    sizes = df.filter(amount > 0).groupBy(row.alias("_t"), F.col(id_col).alias("_d")).agg(F.count(F.lit(1)).alias("c"), F.max(F.ceil((amount + 1) / seq_len)).cast("bigint").alias("room"))
    sizes = written(sizes.withColumn("_k", key60(str(key), F.col("_d"))).withColumn("rooms", F.col("room") * F.col("c")).withColumn("_all", F.lit(0)), "sizes")
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("rooms").alias("m"), F.max("c").alias("c")).first()
    n_places = total.m or 0
    based = written(running(sizes, ["_all"], "_k", [F.col("_d"), F.col("_t")], total.n, {"rooms": "base"}).select("_t", "base", "room", "c"), "bases")
    if (total.c or 1) > 1:  # of texts that repeat under one id the copies take their turns
        again = based.filter("c > 1")
        some = x.join(small(again), "_t").dropDuplicates(["_t"]).withColumn("part", F.explode(F.expr("sequence(0L, (c - 1) div 1000)"))).repartition(F.col("_t"), F.col("part"))
        some = some.withColumn("turn", F.explode(F.expr("sequence(part * 1000, least(c, part * 1000 + 1000) - 1)"))).withColumn("base", F.expr("base + room * turn"))
        x = x.join(small(based.filter("c = 1")), "_t").select("_d", "_x", "base").unionByName(some.select("_d", "_x", "base"))
    else:
        x = x.join(small(based), "_t").select("_d", "_x", "base")
    shards = max(1, -(-n_places // per_shard))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(data.value).encode_ordinary
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                docs, seqs, bases, body = [], [], [], []
                for j, (t, base) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    ids = np.array([*encode(t), end], kind).tobytes()
                    for s in range(-(-len(ids) // stride)):
                        docs.append(j), seqs.append(s), bases.append(base + s), body.append(ids[s * stride : (s + 1) * stride])
                places = feistel(np.array(bases, np.int64), n_places, key)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(docs, pa.int64())), pa.array(seqs, pa.int32()), pa.array(places), pa.array((places // per_shard).astype(np.int32)), pa.array(body, pa.binary())], ["_d", "seq_no", "place", "shard", "body"])

    fill = np.array(end, kind).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(path)
        shard, n, temp, out = None, 0, "", None
        store.create_dir(top, recursive=True)
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in (3, 4)), strict=True))
            at = []
            for s, body in rows:
                if s != shard:
                    if out:
                        out.close()
                        store.move(temp, f"{top}/shard-{shard:08d}.bin")
                    shard, n, temp = s, 0, f"{top}/.{s:08d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temp)
                out.write(body + fill * ((stride - len(body)) // len(fill)))
                at.append(n)
                n += 1
            sizes, crcs = [len(body) // len(fill) for _, body in rows], [zlib.crc32(body) for _, body in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], b.column(3), pa.array(at, pa.int64()), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64())], ["_d", "seq_no", "shard", "record", "n_tokens", "crc32"])
        if out:
            out.close()
            store.move(temp, f"{top}/shard-{shard:08d}.bin")

    made = arrow_map(x, tokenise, f"_d {id_type}, seq_no int, place bigint, shard int, body binary")
    parts = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    ranged = made.repartitionById(parts, F.expr(f"cast(cast(shard as bigint) * {parts} div {shards} as int)")).sortWithinPartitions("shard", "place")
    files = written(arrow_map(ranged, write, f"_d {id_type}, seq_no int, shard int, record bigint, n_tokens int, crc32 bigint"), "sequences")
    counts = files.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))  # a row for each file
    index = counts.select("shard", (F.sum("rows").over(Window.orderBy("shard")) - F.col("rows")).alias("first_slot"), "rows", F.lit(seq_len).alias("seq_len"), F.lit(kind.itemsize).alias("width"), F.lit(end).alias("end"))
    index.write.mode("overwrite").parquet(f"{path}/index")
    index = spark.read.schema("shard int, first_slot bigint").parquet(f"{path}/index")
    return files.join(index, "shard").select(F.col("_d").alias(id_col), "seq_no", (F.col("first_slot") + F.col("record")).alias("slot"), "shard", (F.col("record") * stride).alias("offset"), "n_tokens", "crc32")


def read_from(path: str, slot: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """Up to `count` sequences from `slot` on (all of them without a count), read shard by shard in order by the written index."""
    store, top = fs.FileSystem.from_uri(path)
    index = ds.dataset(f"{top}/index", filesystem=store, format="parquet").to_table().sort_by("first_slot").to_pylist()
    left = sum(r["rows"] for r in index) if count is None else count
    for r in index:
        skip = max(0, slot - r["first_slot"])
        if left > 0 and skip < r["rows"]:
            stride = r["seq_len"] * r["width"]
            with store.open_input_file(f"{top}/shard-{r['shard']:08d}.bin") as f:
                f.seek(skip * stride)
                for _ in range(min(left, r["rows"] - skip)):
                    record = f.read(stride)
                    if len(record) < stride:
                        raise ValueError(f"shard {r['shard']} is shorter than its index says")
                    yield np.frombuffer(record, f"<u{r['width']}")
                    left -= 1


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as shards in the shared folder; a row for each sequence."""
    return materialise(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/order-{uuid.uuid4().hex}")
