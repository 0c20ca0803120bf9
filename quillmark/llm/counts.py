"""Token counts kept as additive rollups of signed changes."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_dir, table, written
from .tokens import RANKS, encoder, vocabulary

BY = ("source", "lang", "tokenizer")
WORDS = "words@1"
BPE = "byte_bpe_multi_50k@1"


def count_tokens(df: DataFrame, id_col: str = "doc_id", text: str = "text", ranks: str = RANKS, version: str = BPE) -> DataFrame:
    """id, source, lang, tokenizer, tokens: for each row of df its count under the vocabulary's version and its number of words.

    The whole text is counted, row by row, with no shuffle. A null text has no tokens; other nulls are kept; repeated rows are
    counted each; an empty table gives an empty result; other columns of df have no effect.
    """
    data = vocabulary(df.sparkSession, ranks)
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(data.value).encode_ordinary
        for b in batches:
            texts = [t or "" for t in b.column(3).to_pylist()]
            counts = [len(encode(t)) for t in texts], [len(t.encode().split()) for t in texts]
            for name, c in zip((version, WORDS), counts, strict=True):
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([name] * len(c), pa.string()), pa.array(c, pa.int64())], [id_col, "source", "lang", "tokenizer", "tokens"])

    return arrow_map(df.select(id_col, F.col("source").cast("string"), F.col("lang").cast("string"), F.col(text).cast("string")), run, f"`{id_col}` {id_type}, source string, lang string, tokenizer string, tokens bigint")


def inserts(counted: DataFrame) -> DataFrame:
    """Signed changes of new documents."""
    return counted.select(*BY, F.lit(1).cast("bigint").alias("docs"), F.col("tokens").cast("bigint").alias("tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Signed changes of documents that go, from the counts that they were inserted with."""
    return inserts(counted).select(*BY, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed changes of documents whose text, source, language or tokenizer version changed."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Totals by source, language and tokenizer version, as the sum of committed batches.

    A batch is a folder `batch=<name>`; each try to write it is a folder `attempt=<time>-<random>` of its own in there, which counts once
    Spark has put its success mark. Of several marked attempts of one name the first counts, so retries, crashes and two writers of
    one name count once. A name stands for its changes: it is committed again without effect. compact() writes a folder `sum=<name>` of the
    same kind, with the sum of all that is live and the list of what it holds; what a live sum holds is no longer read by itself. A sum
    that holds something that another sum took before it is never live, so two compactions at once do no harm.

    Nulls in source, lang and tokenizer are groups of their own, null docs and tokens count as 0. Empty batches are committed like others. Repeated
    rows of changes count as often as they occur. Without batches the totals are empty; groups whose totals are 0 are left out.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _marked(self, kind: str) -> dict[str, str]:
        """Name and folder of the first marked attempt of each batch or sum, in the order in which they were begun."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = sorted((s.getPath().getParent().getParent().getName(), s.getPath().getParent().getParent().getParent().getName()) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}=*/attempt=*/totals/_SUCCESS")) or [])
        out: dict[str, str] = {}
        for attempt, name in found:
            out.setdefault(name, f"{self.path}/{name}/{attempt}")
        return out

    def live(self) -> dict[str, str]:
        """Batches and sums that make up the totals, with their folders: none of them is held by another one."""
        out = self._marked("batch")
        for name, folder in self._marked("sum").items():
            held = [r[0] for r in self.spark.read.parquet(f"{folder}/holds").collect()]  # names of what one compaction replaced
            if all(h in out for h in held):
                for h in held:
                    del out[h]
                out[name] = folder
        return out

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes (source, lang, tokenizer, docs, tokens); False if that batch was committed before."""
        return self._write("batch", batch, changes, None)

    def _write(self, kind: str, name: str, changes: DataFrame, holds: list[str] | None) -> bool:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
            raise ValueError("a batch is named by letters, digits, _ and -")
        if f"{kind}={name}" in self._marked(kind):
            return False
        folder = f"{self.path}/{kind}={name}/attempt={time.time_ns():020d}-{uuid.uuid4().hex}"
        if holds is not None:
            self.spark.createDataFrame([(h,) for h in holds], "name string").write.parquet(f"{folder}/holds")
        changes.groupBy(*BY).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("docs", "tokens")]).write.parquet(f"{folder}/totals")
        return True

    def compact(self, name: str | None = None) -> bool:
        """One sum, of any name, instead of all that is live; False if there is nothing to do or that name was used before."""
        live = self.live()
        return len(live) > 1 and self._write("sum", name or uuid.uuid4().hex, self._changes(live), list(live))

    def _changes(self, live: dict[str, str]) -> DataFrame:
        return self.spark.read.schema("source string, lang string, tokenizer string, docs bigint, tokens bigint").parquet(*[f"{folder}/totals" for folder in live.values()])

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens of all groups that hold documents or tokens."""
        live = self.live()
        if not live:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs bigint, tokens bigint")
        return self._changes(live).groupBy(*BY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of all documents after they came without a language, were revised to have theirs, half of them were deleted and inserted
    again, a batch was sent twice, and the batches were compacted."""
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    counted = written(count_tokens(table(spark, sf_dir, "documents")), "counted")
    bare = counted.withColumn("lang", F.lit(None).cast("string"))
    half = counted.filter(F.xxhash64("doc_id") % 2 == 0)
    rollup.commit("load", inserts(bare))
    rollup.commit("languages", revisions(bare, counted))
    rollup.commit("deleted", deletes(half))
    rollup.commit("inserted", inserts(half))
    rollup.commit("languages", revisions(bare, counted))
    rollup.compact("daily")
    rollup.commit("load", inserts(bare))
    return rollup.totals()
