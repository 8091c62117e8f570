"""Named bands of scores and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, steps: list[tuple[float, str]], other: str, strict: bool = False) -> Column:
    """First label whose lower bound the value reaches (or exceeds, if strict); null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in steps:
        out = out.when((value > bound) if strict else (value >= bound), label)
    return out.otherwise(other)


# The bounds and labels below belong to the result vocabulary.
def quality_category(pct: Column) -> Column:
    return ladder(pct, [(95, "excellent"), (85, "good"), (70, "fair")], "poor")


def sparsity_severity(ratio: Column) -> Column:
    return ladder(
        ratio, [(0.8, "critical"), (0.6, "high"), (0.4, "moderate"), (0.2, "low")], "none", strict=True
    )


def row_emptiness(ratio: Column) -> Column:
    return ladder(
        ratio, [(1.0, "empty"), (0.9, "mostly"), (0.7, "substantially"), (0.4, "partially")], "acceptable"
    )


def quality_flag(score: Column) -> Column:
    return ladder(score, [(100, "COMPLETE"), (50, "PARTIAL")], "INCOMPLETE")


def score_category(score: Column) -> Column:
    return ladder(score, [(90, "excellent"), (75, "good"), (60, "fair"), (40, "poor")], "critical")


def score_assessment(score: Column) -> Column:
    return ladder(score, [(90, "EXCELLENT"), (75, "GOOD"), (60, "FAIR")], "POOR")


def file_verdict(pct: Column, sparse_critical: Column) -> Column:
    return (
        F.when(pct.isNull(), F.lit(None).cast("string"))
        .when(sparse_critical | (pct < 70), "sparse")
        .when(pct >= 95, "excellent")
        .otherwise("acceptable")
    )


def similarity_level(score: Column) -> Column:
    return (
        F.when(score > 0.9, "high").when(score >= 0.7, "medium").when(score >= 0.5, "low").otherwise("weak")
    )


def similarity_bucket(score: Column) -> Column:
    return ladder(score, [(0.9, "90+"), (0.8, "80-90"), (0.7, "70-80")], "<70")


def match_action(score: Column, threshold: float) -> Column:
    return ladder(score, [(0.9, "auto_merge"), (threshold, "manual_review")], "keep_separate")


def risk_level(rate_pct: Column) -> Column:
    return ladder(rate_pct, [(20, "high"), (5, "medium")], "low", strict=True)


def duplicate_status(rate_pct: Column) -> Column:
    return ladder(rate_pct, [(20, "high"), (5, "moderate"), (0, "low")], "clean", strict=True)


def speed_class(ms: Column) -> Column:
    return ladder(ms, [(5000, "slow"), (1000, "normal")], "fast", strict=True)
