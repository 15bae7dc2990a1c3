"""Exact top-k by inner product: three phases with one uniform threshold over score lists.

The dimensions are cut into slices; for one query each slice gives every candidate a partial
score, that is a score list. Queries and candidates meet in blocks, each pair of blocks in a
task of its own, so nothing but a few numbers per query leaves a task.

1. Gather: every block names the best k of each of its lists, and sums the scores of these alone; the
   k-th best of all of them is a score that the true k-th can't be below: the safe cutoff.
2. Collect: the cutoff and the best value of each list go out with the queries. If a candidate
   stays more than an even share of (sum of the lists' best - cutoff) below the best in every
   list, its sum is below the cutoff; all others are sufficient entries.
3. Resolve: whole scores are formed exactly for the entries and for nothing else; the best k are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incognita.llm.common import table, written

SLICES = 4
QUERY_BLOCK = 256
BLOCK = 2048
GROUP = 4  # blocks of candidates that one task takes for one block of queries
EXACT = float(2**53)  # whole numbers up to here are exact as doubles
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows without an id, without a vector, or
    with a component that is NULL, NaN or infinite are left out."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(key).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v")
    )


def _pack(size: int, extra: tuple[str, ...] = ()):
    """Rows to blocks: ids, lengths and components of up to ``size`` vectors, and other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                lists = part.column("v").to_numpy(zero_copy_only=False)
                width = max((len(x) for x in lists), default=0)
                grid = np.zeros((len(lists), width))
                for i, x in enumerate(lists):  # a shorter vector counts as filled up with zeros
                    grid[i, : len(x)] = x
                cells = {"ids": part.column("id").to_numpy().astype(np.int64), "grid": grid}
                cells |= {c: part.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in extra}
                row = {k: [v.tobytes()] for k, v in cells.items()} | {"width": [width]}
                yield pa.RecordBatch.from_pydict(row, schema=pa.schema(_fields(extra)))

    return run


def _fields(extra: tuple[str, ...]) -> list:
    return [(c, pa.binary()) for c in ("ids", "grid", *extra)] + [("width", pa.int32())]


def blocks(vectors: DataFrame, size: int, name: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Vectors as numbered blocks (``name``: 0, 1, …), one row each."""
    schema = ", ".join(f"{c} binary" for c in ("ids", "grid", *extra)) + ", width int"
    packed = written(
        vectors.mapInArrow(_pack(size, extra), schema).withColumn("mark", F.monotonically_increasing_id()), "blocks"
    )
    numbers = packed.select("mark", (F.row_number().over(Window.orderBy("mark")) - 1).alias(name))
    return packed.join(numbers, "mark").drop("mark")


def pairs(queries: DataFrame, n_queries: int, rows: DataFrame, n_rows: int) -> DataFrame:
    """Every block of queries beside every block of candidates, a few pairs to a task."""
    groups = max(1, -(-n_rows // GROUP))
    left = rows.withColumn("g", F.expr(f"c div {GROUP}")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))
    )
    right = queries.withColumn("g", F.explode(F.sequence(F.lit(0).cast("int"), F.lit(groups - 1).cast("int"))))
    left = left.select("q", F.col("g").cast("int").alias("g"), "ids", "grid", "width")
    right = right.select(
        F.col("q").cast("int").alias("q"), "g", *[F.col(c).alias("q_" + c) for c in queries.columns if c != "q"]
    )
    return left.withColumn("q", F.col("q").cast("int")).join(right, ["q", "g"])


def _sides(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Query ids, candidate ids, and the partial scores of each slice (own pairs: -inf)."""
    q_ids, c_ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    width = min(row["q_width"], row["width"])
    q = np.frombuffer(row["q_grid"]).reshape(len(q_ids), row["q_width"])[:, :width]
    c = np.frombuffer(row["grid"]).reshape(len(c_ids), row["width"])[:, :width]
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(width, 1) >= EXACT:
        q, c = (np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape) for a in (q, c))
    lists = []
    for cols in np.array_split(np.arange(width), SLICES):
        part = q[:, cols] @ c[:, cols].T if len(cols) else np.zeros((len(q_ids), len(c_ids)), q.dtype)
        part[q_ids[:, None] == c_ids[None, :]] = -np.inf
        lists.append(part)
    return q_ids, c_ids, lists


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest finite scores of each row, ties to smaller ids."""
    if score.shape[1] > k and score.dtype != object:
        least = np.partition(score, -k, axis=1)[:, -k]
        row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    else:
        row, col = np.nonzero(score > -np.inf)
    return _best_of(row, col, score[row, col], ids, k)[:2]


def _best_of(row: np.ndarray, col: np.ndarray, value: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k highest values of each row among these entries, ties to smaller ids."""
    if value.dtype == object:
        order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -value[i], ids[col[i]])), dtype=np.int64)
    else:
        order = np.lexsort((ids[col], -value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return row[first], col[first], value[first]


def _summed(lists: list[np.ndarray], row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Whole scores of these entries, and of no others."""
    return sum(part[row, col] for part in lists)


def named_entries(lists: list[np.ndarray], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what is among the best k of one of its lists, each once."""
    found = [_best(part, ids, k) for part in lists]
    width = max(len(ids), 1)
    place = np.unique(np.concatenate([r * width + c for r, c in found]))
    return place // width, place % width


def sufficient_entries(lists: list[np.ndarray], cutoff: np.ndarray, peaks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what comes within an even share of (sum of peaks - cutoff) of the peak in some
    list; the sum of all others is below the cutoff. The share is widened by what rounding could take."""
    share = (sum(peaks) - cutoff) / len(lists)
    share = share + 1e-9 * (np.abs(share) + sum(np.abs(p) for p in peaks)) + 1e-6
    enough = np.zeros(lists[0].shape, bool)
    for part, peak in zip(lists, peaks, strict=True):
        enough |= part.astype(float) >= peak - share
    # a query's own vector is -inf in every list, which an infinite share would let in
    return np.nonzero(enough & (lists[0] > -np.inf))


def _whole(value) -> int:
    return max(LOWEST, min(HIGHEST, int(value)))


def _merge(kept: dict, q_id: int, entries: list[tuple[int, int]], k: int) -> None:
    kept[q_id] = sorted(kept.get(q_id, []) + entries)[:k]


def _gather(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        most: dict[int, list[float]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, c_ids, lists = _sides(row)
                r, c = named_entries(lists, c_ids, k)
                for i, j, s in zip(*_best_of(r, c, _summed(lists, r, c), c_ids, k), strict=True):
                    _merge(kept, int(q_ids[i]), [(-_whole(s), int(c_ids[j]))], k)
                for i, q in enumerate(q_ids):
                    peaks = [float(p[i].max(initial=-np.inf)) for p in lists]
                    most[int(q)] = [max(a, b) for a, b in zip(most.get(int(q), peaks), peaks, strict=True)]
        rows = [
            {"query_id": q, "score": -s, **{f"peak{g}": most[q][g] for g in range(SLICES)}}
            for q, best in kept.items()
            for s, _ in best
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
            [("query_id", pa.int64()), ("score", pa.int64()), *[(f"peak{g}", pa.float64()) for g in range(SLICES)]]
        ))

    return run


def _resolve(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, c_ids, lists = _sides(row)
                cutoff = np.frombuffer(row["q_cutoff"])[:, None]
                peaks = [np.frombuffer(row[f"q_peak{g}"])[:, None] for g in range(SLICES)]
                r, c = sufficient_entries(lists, cutoff, peaks)
                for i, j, s in zip(*_best_of(r, c, _summed(lists, r, c), c_ids, k), strict=True):
                    _merge(kept, int(q_ids[i]), [(-_whole(s), int(c_ids[j]))], k)
        rows = [{"query_id": q, "vec_id": v, "score": -s} for q, best in kept.items() for s, v in best]
        yield pa.RecordBatch.from_pylist(
            rows, schema=pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score")])
        )

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, exactly.

    Both frames come from ``whole_vectors``. A candidate with the query's own id takes no part;
    fewer than k candidates are all returned, no candidate gives no row. Vectors of different
    lengths count as filled up with zeros. Of a query id that occurs twice, the vector that is least
    in array order asks. Scores beyond 64 bits are held at the limits of that range.
    """
    spark = queries.sparkSession
    empty = "query_id long, rank int, vec_id long, score long"
    queries = written(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    q_blocks = blocks(queries, QUERY_BLOCK, "q")
    c_blocks = written(blocks(rows, BLOCK, "c"), "blocks")
    n_q, n_c = q_blocks.count(), c_blocks.count()
    if not n_q or not n_c:
        return spark.createDataFrame([], empty)
    peaks = [f"peak{g}" for g in range(SLICES)]
    found = written(
        pairs(q_blocks, n_q, c_blocks, n_c).mapInArrow(
            _gather(k), "query_id long, score long, " + ", ".join(f"{p} double" for p in peaks)
        ),
        "gathered",
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    kth = kth.groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    tops = found.groupBy("query_id").agg(*[F.max(p).alias(p) for p in peaks])
    cutoff = F.when(F.col("n") < k, F.lit(float("-inf"))).otherwise(F.col("low").cast("double"))
    cut = tops.join(kth.select("query_id", cutoff.alias("cutoff")), "query_id").withColumnRenamed("query_id", "id")
    told = blocks(written(queries.join(cut, "id"), "queries"), QUERY_BLOCK, "q", ("cutoff", *peaks))
    n_told = told.count()
    if not n_told:
        return spark.createDataFrame([], empty)
    entries = pairs(told, n_told, c_blocks, n_c).mapInArrow(_resolve(k), "query_id long, vec_id long, score long")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = entries.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best partners of every 50th vector, by inner product of the scaled components."""
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors.filter(F.col("id") % 50 == 0), vectors, 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
