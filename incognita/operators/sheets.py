"""Sheets: named frames with a header row and free cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incognita.functions.text import Patterns, detect_value
from incognita.operators.catalog import detect_columns, row_counts, table_columns
from incognita.operators.tables import ColumnRules, pseudonymize_table, quoted


def name_blank_headers(df: DataFrame) -> DataFrame:
    """Blank column names become ``Column{n}``."""
    return df.toDF(*[c if c.strip() else f"Column{i}" for i, c in enumerate(df.columns, start=1)])


def _string_columns(df: DataFrame, but: str | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != but]


def scan_cells(
    df: DataFrame, sheet: str, row_key: str, patterns: Patterns = "standard"
) -> DataFrame:
    """One row (sheet, row, column, type, value, score) per string cell with a
    pattern in it. ``row_key`` names the column that tells rows apart, as rows of
    a distributed frame have no number. One scan, no shuffle."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(quoted(c)).alias("value"))
            for c in _string_columns(df, row_key)
        ]
    )
    if not _string_columns(df, row_key):  # a sheet of numbers only: no row, same columns
        cells = F.expr("cast(array() AS array<struct<column: string, value: string>>)")
    flat = df.select(F.col(quoted(row_key)).alias("row"), F.inline(cells)).where("value IS NOT NULL")
    return (
        flat.withColumn("verdict", detect_value(F.col("value"), patterns))
        .where("verdict IS NOT NULL")
        .select(
            F.lit(sheet).alias("sheet"),
            "row",
            "column",
            F.col("verdict.type").alias("type"),
            "value",
            F.col("verdict.score").alias("score"),
        )
    )


def profile_sheets(spark: SparkSession, sheets: dict[str, DataFrame]) -> DataFrame:
    """Detected headers per sheet with the number of data rows."""
    named = {name: name_blank_headers(df) for name, df in sheets.items()}
    verdicts = detect_columns(table_columns(spark, named)).where("detected")
    return verdicts.join(row_counts(named), "table").withColumnRenamed("table", "sheet")


def pseudonymize_sheets(
    sheets: dict[str, DataFrame], rules: dict[str, ColumnRules], **options
) -> dict[str, DataFrame]:
    """Per sheet and column; only non-empty strings are replaced."""
    out = {}
    for name, df in sheets.items():
        strings = set(_string_columns(df))
        wanted = {c: r for c, r in rules.get(name, {}).items() if c in strings}
        out[name] = pseudonymize_table(df, wanted, **{"keep_empty": True, **options})
    return out


def scan_sheets(sheets: dict[str, DataFrame], row_key: str, patterns: Patterns = "standard") -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [scan_cells(df, name, row_key, patterns) for name, df in sheets.items()],
    )
