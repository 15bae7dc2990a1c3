import hashlib
from collections import Counter

import data
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from incognita.llm import op10_substrings as op


def starts(parts, length):
    counts = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
    return [[i for i in range(len(p) - length + 1) if counts[p[i : i + length]] > 1] for p in parts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.integers(1, 9))
def test_expansion_finds_every_repeat(parts, length):
    got = op.repeated_starts([np.frombuffer(p, np.uint8) for p in parts], length)
    assert [g.tolist() for g in got] == starts(parts, length)


def test_expansion_of_larger_texts():
    rng = np.random.Generator(np.random.PCG64(2))
    base = [rng.integers(0, 4, 700).astype(np.uint8).tobytes() for _ in range(30)]
    parts = base + [b[:500] + b"x" + b[501:] for b in base[:20]] + [b"ab" * 400]
    got = op.repeated_starts([np.frombuffer(p, np.uint8) for p in parts], 400)
    assert [g.tolist() for g in got] == starts(parts, 400)


def brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    out = []
    for r, t, found in zip(rows, texts, starts(texts, length)):
        gone = np.zeros(len(t) + 1, np.int64)
        for i in found:
            gone[i] += 1
            gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0 if t else np.zeros(0, bool)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        left, at = [], 0
        for c in r[1] or "":  # a character stays if none of its bytes goes
            size = len(c.encode())
            left += [c] * (not gone[at : at + size].any())
            at += size
        out.append((r[0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), "".join(left), len(left)))
    return sorted(out, key=str)


def sample():
    """Copies, edits, shared passages in other surroundings, repeats within a text, periodic texts."""
    passage, other = data.prose(110, 11), data.prose(75, 12)
    rows = data.rows()
    rows += [(100 + i, f"{data.prose(30 + i, 200 + i)} {passage} {data.prose(20, 300 + i)}", None, None, None) for i in range(30)]
    rows += [(200 + i, f"{passage[:300 + i]}é{passage[300 + i:]}", None, None, None) for i in range(60)]
    rows += [(300, f"{other} {other}", None, None, None), (301, "abc " * 400, None, None, None), (302, "x" * 400, None, None, None)]
    rows += [(303, "y" * 401, None, None, None), (304, other[:399], None, None, None), (305, other[:399], None, None, None)]
    return rows


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 20), (3000, 2500), (1 << 20, 0)])
def test_removal_against_brute_force(spark, limits):
    """Gathered at once, in many buckets, and with every window dealt out singly."""
    docs = data.documents(spark, sample()).select("doc_id", "text")
    out = op.without_repeats(docs, 400, 100, *limits).drop("spans")
    assert sorted(data.listed(out), key=str) == brute(sample(), 400)


def test_other_lengths(spark):
    docs = data.documents(spark, sample()).select("doc_id", "text")
    out = op.without_repeats(docs, 60, 20).drop("spans")
    assert sorted(data.listed(out), key=str) == brute(sample(), 60)


def test_empty_table_and_spans(spark):
    assert op.op10_substrings(spark, data.folder(spark, [])).collect() == []
    docs = data.documents(spark, [(1, "a" * 500, None, None, None), (2, "b", None, None, None)]).select("doc_id", "text")
    assert [[tuple(s) for s in r.spans] for r in op.without_repeats(docs).orderBy("doc_id").collect()] == [[(0, 500)], []]
