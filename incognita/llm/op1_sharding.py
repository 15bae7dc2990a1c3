"""Sharding along a Hilbert curve, with DataFrame functions only.

Rows are placed in a grid over several metadata columns, sorted by the index of their cell on
a Hilbert curve, and the sorted sequence is cut into runs. Neighbours on the curve are close
in every column, so each run spans a small box of the grid, and a filter on any of the columns
skips most runs by the boxes that ``manifest`` lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incognita.llm.common import column, free_name, table, written

BITS = 6  # grid cells per column: 2^6
SHARDS = 8


def scaled(value: Column, bits: int = BITS) -> Column:
    """Cell of a number on a logarithmic grid of four steps per doubling (NULL, NaN, below 0: 0)."""
    x = F.when(F.isnan(value.cast("double")), None).otherwise(value.cast("double"))
    cell = F.floor(F.log2(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)) + 1) * 4)
    return F.least(cell, F.lit((1 << bits) - 1)).cast("int")


def spread_out(value: Column, bits: int = BITS) -> Column:
    """Cell of a label: equal labels share one, different ones are spread evenly (NULL: 0)."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value.cast("string")), F.lit(1 << bits))).cast("int")


def curve_steps(dims: int) -> list[int]:
    """What one level of the curve does, for each orientation and each corner of the cube.

    An orientation is where the curve enters a cube (``entry``) and along which axis it leaves
    (``axis``). The corner is turned into the frame of the orientation; its place in the Gray
    code is the digit of the index, and entry and axis of that subcube follow from it.
    Each item holds the next orientation and the digit, the latter in the lowest bits.
    """
    size, mask = 1 << dims, (1 << dims) - 1

    def right(x: int, k: int) -> int:
        k %= dims
        return ((x >> k) | (x << (dims - k))) & mask

    def left(x: int, k: int) -> int:
        return right(x, -k)

    gray = [i ^ (i >> 1) for i in range(size)]
    place = {g: i for i, g in enumerate(gray)}

    def ones(i: int) -> int:  # trailing one bits
        return 0 if not i & 1 else 1 + ones(i >> 1)

    steps = []
    for state in range(size * dims):
        entry, axis = divmod(state, dims)
        for corner in range(size):
            digit = place[right(corner ^ entry, axis + 1)]
            first = 0 if digit == 0 else gray[2 * ((digit - 1) // 2)]
            turn = 0 if digit == 0 else ones(digit - 1 if digit % 2 == 0 else digit)
            state_after = (entry ^ left(first, axis + 1)) * dims + (axis + turn % dims + 1) % dims
            steps.append(state_after * size + digit)
    return steps


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of the grid cell with these coordinates (0 … 2^bits - 1)."""
    dims = len(cells)
    steps = F.lit(curve_steps(dims))

    def level(acc: Column, bit: Column) -> Column:
        corner = reduce(
            lambda a, b: a + b,
            [F.call_function("shiftright", c, bit).bitwiseAND(F.lit(1)) * (1 << i) for i, c in enumerate(cells)],
        )
        step = F.get(steps, acc["state"] * (1 << dims) + corner)
        return F.struct(
            F.shiftright(step, dims).alias("state"),
            (acc["at"] * (1 << dims) + step.bitwiseAND(F.lit((1 << dims) - 1))).cast("long").alias("at"),
        )

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, level, lambda acc: acc["at"])


def positions(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``df`` with the place of each row (from 0) in the total order, and the number of rows.

    No one task sorts everything: range partitions are sorted and written once, numbered by
    partition and place; a prefix sum over the partitions' counts (one row each) turns these into
    places. ``order`` should end with columns that tell rows apart, so that equal leading values
    spread over partitions.
    """
    local, part, before = (free_name(df, x) for x in ("local_id", "range_part", "rows_before"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [column(c) for c in order]
    ranked = written(
        df.repartitionByRange(ranges, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(local, F.monotonically_increasing_id())
        .withColumn(part, F.shiftright(column(local), 33)),
        "order",
    )
    counts = ranked.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    # one row per range partition, a number this job has set itself: small enough to broadcast
    joined = ranked.join(F.broadcast(offsets), part)
    place = column(before) + column(local).bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn(name, place).drop(local, part, before), ranked.count()


def shard_rows(df: DataFrame, cells: dict[str, Column], ties: list[str], shards: int = SHARDS) -> DataFrame:
    """``df`` cut into ``shards`` runs of the curve whose row counts differ by one at most.

    Adds the cells, ``curve_index``, ``shard`` and ``slot`` (place in the shard, from 0). Rows in
    one cell follow ``ties``; rows equal in these, too, are in any order. NULLs lie in cell 0. An
    empty frame gives an empty one, fewer rows than shards leave shards empty. A column of the
    frame that has a name this adds is replaced.
    """
    for name, cell in cells.items():
        df = df.withColumn(name, cell)
    df = df.withColumn("curve_index", hilbert_index([F.col(c) for c in cells]))
    place = free_name(df, "place")
    placed, total = positions(df, ["curve_index", *ties], place)
    shard = F.expr(f"`{place}` * {shards}L div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", column(place) - first)
        .drop(place)
    )


def manifest(sharded: DataFrame, cells: list[str]) -> DataFrame:
    """Per shard its rows and the least and greatest cell in every column, for file pruning."""
    sides = [f(c).alias(f"{n}_{c}") for c in cells for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *sides)


def shards_for(listed: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """Shards whose box holds the wanted cell in every column named."""
    tests = [F.col(f"min_{c}").__le__(v) & F.col(f"max_{c}").__ge__(v) for c, v in wanted.items()]
    return listed.filter(reduce(lambda a, b: a & b, tests, F.lit(True))).select("shard")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, each sorted along the curve."""
    sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def document_cells() -> dict[str, Column]:
    return {
        "source_cell": spread_out(F.col("source")),
        "lang_cell": spread_out(F.col("lang")),
        "length_cell": scaled(F.col("n_chars")),
    }


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards by law ``rows`` along source, language and length.

    Texts are measured where they are read and never shuffled. A NULL text has size 1 and
    checksum 0, NULL metadata lie in cell 0, an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        "lang",
        "n_chars",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = shard_rows(docs, document_cells(), ["doc_id", "text_crc32", "size"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve_index",
        *document_cells(),
    )
