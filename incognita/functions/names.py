"""Column expressions on names, scores and previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from incognita import rules as R


def normalize_name(name: Column) -> Column:
    """Lower case, blanks and hyphens as underscores."""
    return F.lower(F.translate(name, "- ", "__"))


def context_score(weight: Column, multiplier: Column) -> Column:
    return F.round(weight * F.coalesce(multiplier, F.lit(1.0)), 1)


def score_band(score: Column) -> Column:
    return (
        F.when(score >= R.HIGH_SCORE, "high")
        .when(score >= R.MEDIUM_SCORE, "medium")
        .otherwise("low")
    )


def preview(value: Column, width: int = 30) -> Column:
    return F.when(F.length(value) > width, F.concat(F.left(value, F.lit(width)), F.lit("..."))).otherwise(
        value
    )
