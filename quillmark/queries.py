"""The queries over the test tables for this library's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog_queries, corpus_queries, label_queries, lexical_queries, more_queries, rule_queries, run_queries, score_queries, search_queries, text_queries  # noqa: F401  they register themselves
from .plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["readiness_by_lang"](spark, sf_dir)
