"""Centroid clustering with exact integers; the nearest centroid is found by Orchard's search.

Every centroid has the list of all others by distance from it. A vector starts at some centroid
and walks that centroid's list; as soon as a listed one is nearer (or as near, with a smaller
number), the search jumps to its list. Centroids whose distance is known are marked and not
computed again. The walk ends where the list's distances are strictly more than twice the
distance to the current centroid: all that follow are farther away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.llm.common import column, table, text_bytes, written

DIMS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
CHUNK = 4096  # vectors that are searched at once
LARGEST = 1 << 27  # bound of a component after scaling, so that squared distances fit 64 bits


def pack(df: DataFrame, vector: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """The rows whose vector has ``dims`` components, none NULL or not finite, as four-byte integers
    floor(scale * x) in one binary column; other columns stay.

    Vectors with a component of 2^27 or more after scaling take no part: their squared distances
    need not fit 64 bits.
    """
    x = column(vector)
    fine = (F.size(x) == dims) & F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double") * scale) < LARGEST, F.lit(False)))
    kept = df.filter(x.isNotNull() & fine)
    fields = [f for f in df.schema.fields if f.name != vector]
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(scale * values).astype("<i4")
            cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dims), len(batch), [None, pa.py_buffer(whole.tobytes())])
            yield pa.RecordBatch.from_arrays([cells.cast(pa.binary()), *batch.columns[1:]], ["packed", *names])

    names = [f.name for f in fields]
    return kept.select(x, *[column(n) for n in names]).mapInArrow(run, "packed binary" + (", " + schema if schema else ""))


def unpacked(cells: pa.Array, dims: int) -> np.ndarray:
    data, at = text_bytes(cells)
    return data[at[0] : at[-1]].view("<i4").reshape(-1, dims).astype(np.int64)


class Orchard:
    """Nearest of a few integer vectors; ties go to the smaller number."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.int64)
        gaps = ((self.centroids[:, None, :] - self.centroids[None, :, :]) ** 2).sum(axis=2)
        self.lists = np.argsort(gaps, axis=1, kind="stable")
        own = np.arange(len(gaps))[:, None]
        self.lists = self.lists[self.lists != own].reshape(len(gaps), -1)  # others only, equal ones included
        # squared distances: more than twice is more than four times; kept as a fourth, rounded up
        self.limits = -(-np.take_along_axis(gaps, self.lists, axis=1) // 4)
        self.computed = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) for each vector."""
        n, k = len(vectors), len(self.centroids)
        current = np.zeros(n, np.int64)
        best = ((vectors - self.centroids[0]) ** 2).sum(axis=1)
        marked = np.zeros((n, k), bool)
        marked[:, 0] = True
        place = np.zeros(n, np.int64)
        self.computed += n
        active = np.arange(n)
        while len(active):
            active = active[place[active] < k - 1]
            at, c = place[active], current[active]
            # gap > 4 * best, for integers, is ceil(gap / 4) > best
            active = active[self.limits[c, at] <= best[active]]
            other = self.lists[current[active], place[active]]
            place[active] += 1
            fresh = ~marked[active, other]
            rows, other = active[fresh], other[fresh]
            marked[rows, other] = True
            distance = ((vectors[rows] - self.centroids[other]) ** 2).sum(axis=1)
            self.computed += len(rows)
            nearer = (distance < best[rows]) | ((distance == best[rows]) & (other < current[rows]))
            rows = rows[nearer]
            current[rows], best[rows], place[rows] = other[nearer], distance[nearer], 0
        return current, best


def _totals(centroids: np.ndarray, dims: int):
    """Per task and cluster the number of vectors and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        k = len(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for a in range(0, len(batch), CHUNK):
                vectors = unpacked(batch.column(0).slice(a, CHUNK), dims)
                cluster, _ = search.nearest(vectors)
                counts += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, vectors)
        some = np.flatnonzero(counts)
        listed = pa.array(sums[some].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), listed], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray, dims: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for batch in batches:
            for a in range(0, len(batch), CHUNK):
                part = batch.slice(a, CHUNK)
                cluster, distance = search.nearest(unpacked(part.column(0), dims))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(cluster.astype(np.int32)), pa.array(distance)], [*names, "cluster", "distance"]
                )

    return run


def seeds(packed: DataFrame, key: str = "vec_id", k: int = CENTROIDS, seed: int = SEED, dims: int = DIMS) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of ``seed:key``, in that order (fewer rows: all).
    Of equal keys the least bytes come first; rows without a key come last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), column(key).cast("string")), 256)
    rows = packed.select("packed", mark.alias("mark")).orderBy(F.asc_nulls_last("mark"), "packed").limit(k).collect()
    return np.array([np.frombuffer(r.packed, "<i4") for r in rows], np.int64).reshape(-1, dims)


def fit(packed: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` rounds of assigning and taking floors of means.

    A round reads the packed vectors once and shuffles, per task, one number for each component of
    each centroid; so many in all reach the driver.
    """
    dims = centroids.shape[1]
    for _ in range(rounds):
        part = packed.select("packed").mapInArrow(_totals(centroids, dims), "cluster long, n long, sums array<long>")
        part = part.select("cluster", "n", F.posexplode("sums").alias("at", "s"))
        total = part.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        centroids = centroids.copy()
        for row in total.collect():  # a row for each component of a centroid, at most
            centroids[row.cluster, row.at] = int(row.s) // row.n
    return centroids


def assign(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows without the packed vector, with ``cluster`` and squared ``distance``."""
    fields = [f for f in packed.schema.fields if f.name != "packed" and f.name not in ("cluster", "distance")]
    schema = ", ".join([*[f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields], "cluster int, distance long"])
    names = [f.name for f in fields]
    return packed.select("packed", *[column(n) for n in names]).mapInArrow(_assigned(centroids, centroids.shape[1], names), schema)


def clustered(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = CENTROIDS, rounds: int = ROUNDS,
    seed: int = SEED, dims: int = DIMS, scale: int = SCALE,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector kept.

    Left out are vectors that are NULL, have another number of components, or hold NULL, NaN or
    infinite ones. Fewer vectors than centroids give as many centroids; equal vectors may be several
    centroids, of which the least number gets all; an empty table gives no rows; repeated rows give
    repeated rows and count as often. A NULL key stays NULL.
    """
    out = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    packed = written(pack(df.select(column(key), column(vector)), vector, dims, scale), "vectors")
    start = seeds(packed, key, k, seed, dims)
    if not len(start):
        names = [packed.schema[key].dataType.simpleString(), out]
        return df.sparkSession.createDataFrame([], f"`{key}` {', '.join(names)}")
    centroids = fit(packed, start, rounds)
    found = written(assign(packed, centroids), "assigned")
    sums = {r.cluster: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    total = sum(sums.values())
    each = df.sparkSession.createDataFrame(
        [(c, sums[c], total, digest[c]) for c in sorted(sums)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    # one row a centroid, at most ``k``: small enough to broadcast
    return found.join(F.broadcast(each), "cluster").select(column(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 40 clusters after five rounds; see ``clustered`` for odd rows."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Five rounds and a last assignment, each a step of its own."""
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, c FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64))""",
        """k0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, c FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40)""",
    ]
    for i in range(6):
        steps.append(
            f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, c, m.k AS k, m.d AS d FROM (
    SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.c) AS c,
      min({{'d': list_sum(list_transform(list_zip(v.c, k{i}.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'k': k{i}.k}}) AS m
    FROM v CROSS JOIN k{i} GROUP BY v.r))"""
        )
        if i < 5:
            steps.append(
                f"""k{i + 1} AS MATERIALIZED (
  SELECT k{i}.k, coalesce(m.c, k{i}.c) AS c FROM k{i} LEFT JOIN (
    SELECT k, list((s - (s % n + n) % n) // n ORDER BY j)::BIGINT[] AS c FROM (
      SELECT k, j, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(c) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY k, j)
    GROUP BY k) m ON m.k = k{i}.k)"""
            )
    steps.append("e AS (SELECT k, sum(d)::BIGINT AS cluster_inertia FROM a5 GROUP BY k)")
    return (
        "WITH "
        + ",\n".join(steps)
        + """
SELECT vec_id, k::INTEGER AS cluster, d AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a5) AS inertia,
  sha256(array_to_string(k5.c, ',')) AS centroid_sha256
FROM a5 JOIN e USING (k) JOIN k5 USING (k)
"""
    )


SQL = _sql()
