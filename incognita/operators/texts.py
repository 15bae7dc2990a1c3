"""Findings in text columns as ordinary frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.functions.names import preview, score_band
from incognita.functions.preserve import PreserveRules
from incognita.functions.text import Patterns, find_all
from incognita.operators.tables import quoted


def _kept(df: DataFrame, column: str, added: list[str]) -> list[Column]:
    """All columns but the text, refusing names that the result uses itself."""
    keep = [c for c in df.columns if c != column]
    clash = [c for c in keep if c.lower() in added]
    if clash:
        raise ValueError(f"rename the columns {clash}: the result has columns of these names")
    return [F.col(quoted(c)) for c in keep]


def findings(
    df: DataFrame,
    column: str = "text",
    patterns: Patterns = "standard",
    types: list[str] | None = None,
    preserve: PreserveRules | None = None,
) -> DataFrame:
    """One row per match, with all other columns of the input. Preserved values are
    listed as well; with ``preserve`` a flag column tells which they are."""
    keep = _kept(df, column, ["start", "end", "type", "value", "score", "finding", "preserved"])
    out = df.select(*keep, F.explode(find_all(F.col(quoted(column)), patterns, types)).alias("finding"))
    out = out.select(*keep, "finding.*")
    return out if preserve is None else out.withColumn("preserved", preserve.matches(F.col("value")))


def distinct_findings(found: DataFrame) -> DataFrame:
    """Review list: one row per (type, value) with a shortened value and a band.
    Equal findings are merged map-side before the shuffle."""
    return found.groupBy("type", "value").agg(F.max("score").alias("score")).select(
        "type", "value", "score", preview(F.col("value")).alias("display"), score_band(F.col("score")).alias("band")
    )


def document_findings(df: DataFrame, column: str = "text") -> DataFrame:
    """One row per match of the document patterns."""
    keep = _kept(df, column, ["f", "type", "value", "position", "method", "action"])
    out = df.select(*keep, F.explode(find_all(F.col(quoted(column)), "document")).alias("f"))
    return out.select(
        *keep,
        "f.type",
        "f.value",
        F.col("f.start").alias("position"),
        F.lit("regex").alias("method"),
        F.lit("pseudonymize").alias("action"),
    )


def document_profile(df: DataFrame, column: str = "text") -> DataFrame:
    """Number of findings and text length per document."""
    keep = _kept(df, column, ["total_findings", "text_length"])
    text = F.col(quoted(column))
    return df.select(
        *keep,
        F.size(find_all(text, "document")).alias("total_findings"),
        F.coalesce(F.length(text), F.lit(0)).alias("text_length"),
    )


def text_sample(text: Column, width: int = 500) -> Column:
    return F.substring(text, 1, width)
