import hashlib
import math

import data
import numpy as np
import pytest

from incognita.llm import op13_centroids as op


def brute(rows, k=40, rounds=5, seed=2):
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, j, d in found:
        inertia[j] = inertia.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, j, d in found), key=str)


def vectors(n, seed=1, spread=1.0):
    rng = np.random.Generator(np.random.PCG64(seed))
    heart = rng.normal(size=(7, 64))
    return [(i, (heart[i % 7] + spread * rng.normal(size=64)).astype(np.float32).tolist(), 0) for i in range(n)]


def ours(spark, rows):
    return sorted(data.listed(op.op13_centroids(spark, data.folder(spark, [], embeddings=rows))), key=str)


def test_against_brute_force(spark):
    rows = vectors(250)
    rows += [(250 + i, rows[3][1], 0) for i in range(150)]  # a vector many times, among the first centroids, too
    assert ours(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = vectors(60, 2)
    bad = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [float("-inf")] + [1.0] * 63]
    rows += [(100 + i, v, 0) for i, v in enumerate(bad)]
    rows += [rows[5], (5, rows[6][1], 0), (None, rows[7][1], 0), (200, [-0.001] * 64, 0), (201, [3e5] * 64, 0)]
    assert ours(spark, rows) == brute(rows)


def test_few_and_no_rows(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(1, [1.0], 0), (2, None, 0)]) == []
    assert ours(spark, vectors(1)) == brute(vectors(1))
    assert ours(spark, [(i, [0.5] * 64, 0) for i in range(50)]) == brute([(i, [0.5] * 64, 0) for i in range(50)])


def test_too_large_components_take_no_part(spark):
    rows = vectors(50) + [(99, [1e30] + [0.0] * 63, 0)]
    assert ours(spark, rows) == brute(rows[:-1])


def test_other_columns_and_names(spark):
    rows = vectors(30)
    frame = spark.createDataFrame([(i, v, 7) for i, v, _ in rows], "`vec id` long, `v` array<float>, cluster int")
    out = op.clustered(frame, "v", "vec id")
    assert out.columns[0] == "vec id" and sorted(data.listed(out), key=str) == brute(rows)


@pytest.mark.parametrize("k", [1, 2, 40])
def test_search_finds_the_nearest_and_computes_few(k):
    rng = np.random.default_rng(k)
    hearts = rng.integers(-3000, 3000, (k, 64))
    hearts[k // 2] = hearts[0]  # equal centroids: the smaller number wins
    points = hearts[rng.integers(0, k, 5000)] + rng.integers(-100, 100, (5000, 64))
    search = op.Orchard(hearts)
    cluster, distance = search.nearest(points)
    every = ((points[:, None, :] - hearts[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    if k == 40:  # far apart, a vector's own centroid ends the walk before half of the others were seen
        assert search.computed < 5000 * 40 * 0.75


def test_ties_on_a_line():
    hearts = np.arange(0, 80, 2)[::-1, None] * np.eye(1, 64, dtype=np.int64)
    points = np.arange(-5, 90)[:, None] * np.eye(1, 64, dtype=np.int64)
    cluster, distance = op.Orchard(hearts).nearest(points)
    every = ((points[:, None, :] - hearts[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_more_vectors_than_are_searched_at_once(spark):
    made = spark.range(9000).selectExpr("id AS vec_id", "transform(sequence(0, 63), i -> CAST(pmod(hash(id % 700, i), 2000) / 500 AS FLOAT)) AS embedding")
    made = made.coalesce(1)
    out = sorted(data.listed(op.clustered(made)), key=str)
    rows = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in made.collect()]
    points = np.array([v for _, v in rows])
    order = sorted(range(len(rows)), key=lambda i: hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest())
    hearts = points[order[:40]]
    for step in range(6):
        gaps = ((points[:, None, :] - hearts[None]) ** 2).sum(axis=2)
        cluster = gaps.argmin(axis=1)
        if step < 5:
            hearts = np.array([points[cluster == j].sum(axis=0) // max((cluster == j).sum(), 1) if (cluster == j).any() else hearts[j] for j in range(40)])
    assert [r[:3] for r in out] == sorted(((rows[i][0], int(cluster[i]), int(gaps[i, cluster[i]])) for i in range(len(rows))), key=str)
