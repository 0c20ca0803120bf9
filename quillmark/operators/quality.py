"""Declarative data-quality rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("error", "warning")


@dataclass(frozen=True)
class Rules:
    """What items must keep; None leaves a rule out."""

    required_fields: tuple[str, ...] = ()
    max_duplicate_rate: float | None = None
    min_chunk_coverage: float | None = None
    bad_extensions: tuple[str, ...] = ()
    max_age_days: int | None = None
    file_size: tuple[int | None, int | None] = (None, None)
    content_length: tuple[int | None, int | None] = (None, None)
    severity: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.max_duplicate_rate is not None and not 0 <= self.max_duplicate_rate <= 1:
            raise ValueError("max_duplicate_rate is a share")
        if self.min_chunk_coverage is not None and not 0 <= self.min_chunk_coverage <= 1:
            raise ValueError("min_chunk_coverage is a share")
        if set(self.severity.values()) - set(SEVERITIES):
            raise ValueError("a severity is error or warning")

    def extensions(self) -> list[str]:
        return ["." + e.lower().lstrip(".") for e in self.bad_extensions]


def violations(items: DataFrame, rules: Rules, as_of: Column | None = None, text: str = "text", path: str = "source_path", size: str = "file_size", created: str = "created_at", covered: str = "covered") -> DataFrame:
    """rule, severity, affected, total of each broken rule: one pass of counts over the items, one over digests of their texts for duplicates, then unpivoted.

    A missing, empty or unreadable value breaks required_fields and freshness; shares are compared with their limits, and the rest break on one item.
    """
    n = F.count(F.lit(1))
    tests: dict[str, Column] = {}
    for f in rules.required_fields:
        tests[f"required_fields:{f}"] = F.count_if(F.coalesce(F.trim(F.col(f).cast("string")) == "", F.lit(True)))
    if rules.bad_extensions:
        tests["bad_extensions"] = F.count_if(F.regexp_extract(F.lower(F.coalesce(F.col(path), F.lit(""))), r"(\.[^./]+)$", 1).isin(*rules.extensions()))
    if rules.max_age_days is not None:
        day = F.col(created).cast("string").try_cast("timestamp")
        tests["min_freshness"] = F.count_if(F.coalesce(day < as_of - F.expr(f"INTERVAL {rules.max_age_days} DAYS"), F.lit(True)))
    for name, (low, high), value in (("file_size", rules.file_size, F.col(size)), ("content_length", rules.content_length, F.length(F.coalesce(F.col(text), F.lit(""))))):
        if low is not None:
            tests[f"{name}:under"] = F.count_if(value < low)
        if high is not None:
            tests[f"{name}:over"] = F.count_if(value > high)
    if rules.min_chunk_coverage is not None:
        tests["min_chunk_coverage"] = F.count_if(~F.coalesce(F.col(covered), F.lit(False)))
    one = items.agg(n.alias("total"), *[c.alias(k) for k, c in tests.items()])
    names = list(tests)
    if rules.max_duplicate_rate is not None:
        d = items.groupBy(F.md5(F.coalesce(F.col(text), F.lit("")))).agg(n.alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("max_duplicate_rate"))
        one = one.join(d, F.lit(True))
        names.append("max_duplicate_rate")
    long = one.unpivot(["total"], [F.col(f"`{c}`") for c in names], "rule", "affected")
    share = F.col("affected") / F.greatest(F.col("total"), F.lit(1))
    broken = F.when(F.col("rule") == "max_duplicate_rate", share > F.lit(rules.max_duplicate_rate)).when(F.col("rule") == "min_chunk_coverage", 1 - share < F.lit(rules.min_chunk_coverage)).otherwise(F.col("affected") > 0)
    kind = F.split("rule", ":")[0]
    severity = F.lit("error")
    for k, v in rules.severity.items():
        severity = F.when(kind == k, v).otherwise(severity)
    return long.filter(broken).select("rule", severity.alias("severity"), "affected", "total")


def report(found: DataFrame) -> DataFrame:
    """One row: violations, errors, warnings and a quality score of 1 less the weighted affected share, an error weighing twice a warning."""
    errors, warnings = F.coalesce(F.sum(F.when(F.col("severity") == "error", F.col("affected"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("severity") == "warning", F.col("affected"))), F.lit(0))
    score = F.greatest(F.lit(0.0), 1 - (errors * 2 + warnings) / F.greatest(F.lit(1), F.coalesce(F.max("total"), F.lit(0)) * 2))
    return found.agg(F.count(F.lit(1)).alias("violations"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.round(score, 6).alias("quality"))
