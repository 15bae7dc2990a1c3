"""Partition layout."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL_INPUT = 4 << 30  # bytes of files up to which an input is dealt anew


def spread(df: DataFrame, tasks_per_core: int = 1, limit: int = SMALL_INPUT) -> DataFrame:
    """Gives a small input one partition per core before work that is heavy on the CPU (a file with
    one row group is read by one task, however many cores wait).

    The bytes that the plan says are read decide: where they fill a split per core, or are more
    than ``limit``, nothing is shuffled. Nothing runs, and no list of files is fetched.
    """
    session = df.sparkSession
    if df.isStreaming:
        return df
    wanted = session.sparkContext.defaultParallelism * tasks_per_core
    split = int(session._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(wanted) if size < min(limit, wanted * split) else df
