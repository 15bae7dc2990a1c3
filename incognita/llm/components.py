"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incognita.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of ``edges`` (a, b longs).

    Alternates two steps until nothing changes: every node points its larger neighbours at its
    least neighbour, then every node points its smaller neighbours and itself there. Both keep
    the components and need few rounds, also for chains. Sums and minima are merged before each
    shuffle; the joins on a node with very many edges are left to be split by Spark, as nothing
    needs the rows of a node together. Each round is written, so a lost executor costs one round.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        "edges",
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        now = written(small, "edges")
        told = now.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
        ).first()
        if told == state:
            break
        state = told
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return written(stars.unionByName(roots), "components")
