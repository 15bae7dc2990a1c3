import math

import data
import numpy as np
import pytest

from incognita.llm import op8_topk as op


def brute(rows, k=5, each=50):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in fine:
        if i % each == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def ours(spark, rows):
    return sorted(data.listed(op.op8_topk(spark, data.folder(spark, [], embeddings=rows))))


def vectors(n, dims, seed=1):
    rng = np.random.Generator(np.random.PCG64(seed))
    return [(i, rng.normal(size=dims).astype(np.float32).tolist(), 0) for i in range(n)]


@pytest.mark.parametrize("sizes", [(2048, 256), (64, 3)])
def test_against_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(op, "BLOCK", sizes[0])
    monkeypatch.setattr(op, "QUERY_BLOCK", sizes[1])
    rows = vectors(700, 9)
    rows += [(700 + i, rows[3][1], 0) for i in range(200)]  # one vector many times, as query, too
    assert ours(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 3) + [(100, None, 0), (150, [1.0, None, 2.0], 0), (200, [nan, 1.0, 1.0], 0), (250, [inf, 0.0, 0.0], 0)]
    rows += [(None, [1.0, 1.0, 1.0], 0), (300, [], 0), (350, [5.0], 0), (400, [1.0, 2.0, 3.0, 4.0], 0), (0, [0.5, 0.5, 0.5], 0)]
    assert ours(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [3e5 + i, -2e4 * i, 1e6], 0) for i in range(0, 100, 10)]
    assert ours(spark, rows) == brute(rows)


def test_few_and_no_rows(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(50, [1.0, 2.0], 0)]) == []
    assert ours(spark, [(50, [1.0, 2.0], 0), (51, [1.0, -2.0], 0)]) == brute([(50, [1.0, 2.0], 0), (51, [1.0, -2.0], 0)])
    assert ours(spark, vectors(30, 4)[1:]) == []


def test_whole_scores_are_formed_for_few(spark):
    """Of 40 queries and 2,000 candidates: the named ones, and those the cutoff leaves."""
    rng = np.random.default_rng(4)
    q, c = (np.floor(256 * rng.normal(size=(n, 64))) for n in (40, 2000))
    ids = np.arange(2000)
    lists = [q[:, d] @ c[:, d].T for d in np.array_split(np.arange(64), op.SLICES)]
    whole = sum(lists)
    row, col = op.named_entries(lists, ids, 5)
    assert len(row) <= 40 * 5 * op.SLICES and (op._summed(lists, row, col) == whole[row, col]).all()
    cutoff = np.array([np.sort(whole[i, col[row == i]])[-5] for i in range(40)])[:, None]
    peaks = [part.max(axis=1)[:, None] for part in lists]
    row, col = op.sufficient_entries(lists, cutoff, peaks)
    assert len(row) < 0.6 * whole.size
    left = np.ones(whole.shape, bool)
    left[row, col] = False
    assert (whole[left] < np.broadcast_to(cutoff, whole.shape)[left]).all()
