"""JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """One document per line (or, with ``multi_line``, per file). Invalid input is an
    error. Give ``schema`` to save the pass that infers it."""
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One document per line, nulls written, characters beyond ASCII as they are."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
