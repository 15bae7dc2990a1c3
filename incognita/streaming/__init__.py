"""The same expressions on streams.

Replacing is a pure function of each row, so a stream needs no state and no
watermark, and a restarted query writes the same fakes again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from incognita.functions.text import pseudonymize_text
from incognita.operators.tables import ColumnRules, pseudonymize_table


def pseudonymize_stream(stream: DataFrame, rules: ColumnRules, **options) -> DataFrame:
    """Column rules on a streaming frame."""
    if not stream.isStreaming:
        raise ValueError("not a streaming frame")
    return pseudonymize_table(stream, rules, **options)


def pseudonymize_text_stream(stream: DataFrame, column: str = "text", **options) -> DataFrame:
    """Patterns in a text column of a streaming frame."""
    return stream.withColumn(column, pseudonymize_text(F.col(column), **options))


def start_available(
    stream: DataFrame, path: str, checkpoint: str, output_format: str = "parquet"
) -> StreamingQuery:
    """Starts a query that works off what is there and stops. ``checkpoint`` must lie
    in a folder all executors share; a rerun goes on where the last one ended."""
    return (
        stream.writeStream.format(output_format)
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
