"""Plain text, one row per text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII "record separator": lets many texts share one splittable file.
RECORD_END = "\u001e"


def read_text(spark: SparkSession, path: str, record_end: str | None = None) -> DataFrame:
    """(path, text): one row per file, or per record where ``record_end`` is given.

    A file read whole is one row in one task, so collections of any size should
    come as records.
    """
    reader = spark.read
    df = reader.text(path, lineSep=record_end) if record_end else reader.text(path, wholetext=True)
    return df.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_text(
    df: DataFrame, column: str, path: str, record_end: str = RECORD_END, mode: str = "errorifexists"
) -> None:
    df.select(column).write.mode(mode).text(path, lineSep=record_end)
