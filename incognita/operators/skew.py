"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incognita.functions.arrays import literal_map

HOT_LIMIT = 256
TRACKED_ITEMS = 4_000
SKETCH_GROUPS = 256


def hot_values(df: DataFrame, column: str | Column) -> dict[str, int]:
    """Values that hold more rows than a shuffle partition has on average, at most HOT_LIMIT,
    with the number of partitions their rows should go to: twice as many as they would fill.

    One pass with bounded frequent-items sketches. Each task fills one; groups of
    tasks merge theirs in parallel, and the driver adds up at most SKETCH_GROUPS x
    HOT_LIMIT counts, whatever the size of the input. The counts only steer the
    layout of a join; results never depend on their accuracy.
    """
    group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS))
    value = F.col(f"`{column}`") if isinstance(column, str) else column
    found = df.select(group.alias("__group"), value.alias("__item"))
    top = F.expr(f"approx_top_k(__item, {HOT_LIMIT}, {TRACKED_ITEMS})")
    merged = found.groupBy("__group").agg(top.alias("top"), F.count("__item").alias("rows"))
    counts: Counter[str] = Counter()
    total = 0
    for row in merged.collect():
        total += row["rows"]
        for x in row["top"] or []:
            if x["item"] is not None:
                counts[x["item"]] += x["count"]
    fair = max(2.0, total / _partitions(df))
    return {value: -(-int(2 * n) // int(fair)) for value, n in counts.most_common(HOT_LIMIT) if n > fair}


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salted_left_join(left: DataFrame, right: DataFrame, key: str, hot: dict[str, int]) -> DataFrame:
    """``left`` left-joined with ``right`` on ``key``, hot keys spread over as many
    partitions as ``hot`` states.

    Only rows with a hot key get a salt, and only the matching few rows of
    ``right`` are repeated, once per salt. Rows without a key (NULL) can match
    nothing and are spread over all partitions. Every salt finds its partner, so the
    result does not depend on how salts are dealt out.
    """
    name = F.col(f"`{key}`")
    known = F.try_element_at(literal_map({k: str(n) for k, n in hot.items()}), name).cast("int") if hot else F.lit(None).cast("int")
    salts = F.coalesce(known, F.when(name.isNull(), _partitions(left)).otherwise(1))
    salted_left = left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), salts.cast("long")).cast("int"))
    every = F.sequence(F.lit(0), F.coalesce(known, F.lit(1)) - 1)
    salted_right = right.where(name.isNotNull()).withColumn("__salt", F.explode(every))
    return salted_left.join(salted_right, [key, "__salt"], "left").drop("__salt")
