"""The corpus pipeline: documents that are good, different, free of benchmarks, mixed by source, and sharded.

Each stage takes all rows that the one before kept, as a Parquet table, and returns the columns of documents; the last one adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.classifier import keep_good
from quillmark.llm.common import table, written
from quillmark.llm.decontamination import decontaminate
from quillmark.llm.mixing import mix
from quillmark.llm.neardup import keep_one
from quillmark.llm.sharding import interleave

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score 0.7 or more), each by its own text; all of them if there is nothing to learn from."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at 80 % make; null ids and texts without words stay."""
    return keep_one(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, three of a document at most; null and empty texts have no words and aren't taken."""
    return mix(docs).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, nulls and repeated ones too, with the shard and slot they are in."""
    return interleave(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("shards", shards)]

#: A classifier and MinHash are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the application's scratch folder and read again.

    Null ids, texts and sources pass as the operators say, repeated rows are near duplicates of each other, and without documents the result is empty."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
