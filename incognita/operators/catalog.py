"""Which columns of which tables hold personal data, judged by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita import rules as R
from incognita.functions.arrays import sql_literal
from incognita.functions.names import context_score, normalize_name

# Rule lists are typed by people; beyond this size the join is left to Spark.
BROADCAST_RULES = 10_000


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of the tables and views of the session, in name order."""
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("name")).orderBy("name")


def table_columns(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    primary_keys: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One row per column in ordinal order; primary keys as told by the caller."""
    keys = primary_keys or {}
    rows = [
        (table, f.name, i, f.dataType.simpleString(), f.nullable, f.name in keys.get(table, []))
        for table, df in tables.items()
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(
        rows,
        "table string, column string, ordinal int, dtype string, nullable boolean, primary boolean",
    )


def primary_keys(columns: DataFrame) -> DataFrame:
    return columns.where("primary").select("table", "column", "ordinal")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table; each count is a metadata-sized aggregate of its own scan."""
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table"), "row_count")
            for t, df in tables.items()
        ]
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_RULES else df


def _values_frame(spark: SparkSession, rows: list[tuple], names: str, schema: str) -> DataFrame:
    """A small constant frame the optimizer knows the size of."""
    if not rows:
        return spark.createDataFrame([], schema)
    shown = ", ".join("(" + ", ".join(map(sql_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {shown} AS t({names})")


def rule_frame(spark: SparkSession, rules: list[R.ColumnRule] | None = None) -> DataFrame:
    rows = [
        (r.name, r.type, r.faker, r.weight, i)
        for i, r in enumerate(R.COLUMN_RULES if rules is None else rules)
    ]
    return _values_frame(
        spark,
        rows,
        "rule_name, type, faker_method, weight, ordinal",
        "rule_name string, type string, faker_method string, weight int, ordinal int",
    )


def context_frame(spark: SparkSession, context: dict[str, float] | None = None) -> DataFrame:
    rows = [(t, float(m)) for t, m in (R.TABLE_CONTEXT if context is None else context).items()]
    return _values_frame(
        spark, rows, "context_table, multiplier", "context_table string, multiplier double"
    )


def detect_columns(
    catalog: DataFrame,
    rules: list[R.ColumnRule] | None = None,
    context: dict[str, float] | None = None,
) -> DataFrame:
    """Adds the verdict (detected, type, faker_method, score, method, action) to a
    frame with ``table`` and ``column``. The rule lists are broadcast, so a
    catalog of any length is judged without a shuffle."""
    spark = catalog.sparkSession
    rule_list = R.COLUMN_RULES if rules is None else rules
    context_map = R.TABLE_CONTEXT if context is None else context
    named = rule_frame(spark, rule_list).drop("ordinal")
    known_tables = context_frame(spark, context_map)
    judged = (
        catalog.withColumn("rule_name", normalize_name(F.col("column")))
        .withColumn("context_table", F.lower("table"))
        .join(_small(named, len(rule_list)), "rule_name", "left")
        .join(_small(known_tables, len(context_map)), "context_table", "left")
    )
    detected = F.col("type").isNotNull()
    return judged.select(
        *catalog.columns,
        detected.alias("detected"),
        "type",
        "faker_method",
        F.when(detected, context_score(F.col("weight"), F.col("multiplier")))
        .otherwise(0.0)
        .alias("score"),
        F.when(detected, "column_name").alias("method"),
        F.when(detected, "pseudonymize").otherwise("keep").alias("action"),
    )


def available_types(spark: SparkSession, rules: list[R.ColumnRule] | None = None) -> DataFrame:
    """Each type with its generator name; the last rule of a type decides."""
    return (
        rule_frame(spark, rules)
        .groupBy("type")
        .agg(F.max_by("faker_method", "ordinal").alias("faker_method"))
    )


def analyze_schema(
    spark: SparkSession, tables: dict[str, DataFrame], with_counts: bool = True
) -> DataFrame:
    """Detected columns of all tables with the row count of their table; tables
    without a detected column do not appear (and are not counted)."""
    verdicts = detect_columns(table_columns(spark, tables)).where("detected")
    if not with_counts:
        return verdicts
    hit = [t for t, df in tables.items() if any(R.column_rule(c) for c in df.columns)]
    if not hit:
        return verdicts.withColumn("row_count", F.lit(0).cast("bigint"))
    return verdicts.join(row_counts({t: tables[t] for t in hit}), "table")


def suggest_rules(table: str, df: DataFrame, rules: list[R.ColumnRule] | None = None) -> dict:
    """The detection result of one table in the form the apply operators take."""
    found = {c: R.column_rule(c, rules) for c in df.columns}
    return {c: {"action": "pseudonymize", "type": r.type} for c, r in found.items() if r}
