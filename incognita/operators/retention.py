"""Row retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_expired(df: DataFrame, ts: str, ttl: timedelta, now: datetime) -> DataFrame:
    """Rows not older than ``ttl`` at the time ``now``. The bound is a literal, so
    the filter reaches the scan and prunes row groups and partitions."""
    return df.where(F.col(ts) >= F.lit(now - ttl))
