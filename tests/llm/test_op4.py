import re
from collections import defaultdict

import data
import pytest

from incognita.llm import op4_neardup as op
from incognita.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return set(zip(words, words[1:], words[2:]))


def brute(rows):
    """(doc_id, n, component, kept) by holding every pair of rows against each other."""
    sets = [(r[0], shingles(r[1])) for r in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def ours(spark, rows):
    out = op.op4_neardup(spark, data.folder(spark, rows))
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=str)


def edited(base, places):
    words = base.split()
    for p in places:
        words[p % len(words)] = f"edit{p}"
    return " ".join(words)


def test_odd_rows(spark):
    rows = data.rows() + [(20, "A b", None, None, None), (21, "a  B", None, None, None), (22, "a b c", None, None, None)]
    assert ours(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert ours(spark, []) == []


@pytest.mark.parametrize("block", [256, 7])
def test_group_of_edited_copies(spark, monkeypatch, block):
    """Copies with one to nine edits, most of them no link of the base: chains, and many lists
    with members of several components."""
    monkeypatch.setattr(op, "BLOCK", block)
    base = data.prose(140, 77)
    words = " ".join(f"w{i}{w}" for i, w in enumerate(base.split()))
    rows = [(i, edited(words, [(i * 37 + k * 11) % 140 for k in range(i % 10)]), None, None, None) for i in range(150)]
    rows += [(1000 + i, edited(words, [0, 50, 100]), None, None, None) for i in range(40)]
    rows += [(2000 + i, " ".join(f"z{i}{k}" for k in range(60)) + " " + words[:400], None, None, None) for i in range(20)]
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) > 25
    assert ours(spark, rows) == want


def test_components_of_chains_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7), (500, 400), (400, 500)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = defaultdict(int) | {i: 0 for i in range(61)} | {100 + i: 100 for i in range(200)} | {400: 400, 500: 400}
    assert out == dict(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
