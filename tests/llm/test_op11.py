import hashlib
import math
import re
import zlib
from collections import Counter

import data
import numpy as np
import pyarrow as pa
import pytest

from incognita.llm import op11_importance as op

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def brute(docs, target):
    own = [runs(t) for _, t in docs]
    s = Counter(bucket(f) for _, fs in own for f in fs)
    t = Counter(bucket(f) for x in target for f in runs(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in s}
    out = []
    for (key, _), (words, fs) in zip(docs, own, strict=True):
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[:8], 16)
        score = None if key is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(fs), weight, score, None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (r[3] is None, -(r[3] or 0), r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def ours(spark, docs, target):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    other = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(data.listed(op.resample(frame, other)), key=str)


def test_against_brute_force(spark):
    docs = [(r[0], r[1]) for r in data.rows()] + [(1000 + i, data.prose(15 + i % 90, i)) for i in range(300)]
    docs += [(7, data.prose(80, 5))] * 60 + [(2000, "wörter ÄÖ 日本 " * 40), (2001, "x y  z " * 30), (2002, "long" * 5000 + " a b " * 20), (2003, "A-b_c.1,2\x003 " * 9)]
    target = [data.prose(40, 3), None, "", "日本 wörter", data.prose(30, 400)]
    assert ours(spark, docs, target) == brute(docs, target)


def test_several_batches_of_unlike_texts(spark):
    docs = [(i, None if i % 7 == 0 else "" if i % 5 == 0 else data.prose(i % 40, i)) for i in range(1200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    out = op.resample(frame, spark.createDataFrame([("river stone",)], "text string"))
    assert sorted(data.listed(out), key=str) == brute(docs, ["river stone"])


def test_empty_tables(spark):
    assert ours(spark, [], ["a b"]) == []
    docs = [(i, data.prose(30, i)) for i in range(40)]
    assert ours(spark, docs, []) == brute(docs, [])
    assert ours(spark, [(1, None), (2, ""), (None, "one")], ["one"]) == brute([(1, None), (2, ""), (None, "one")], ["one"])


def test_other_columns_and_names(spark):
    docs = [(f"k{i}", data.prose(30, i), i) for i in range(60)]
    frame = spark.createDataFrame(docs, "`the key` string, rank string, place int")
    out = op.resample(frame, spark.createDataFrame([("river",)], "rank string"), text="rank", key="the key")
    assert out.columns == ["the key", "place", "n_features", "weight", "score", "rank"]
    assert sorted(r.rank for r in out.collect() if r.rank) == [1, 2, 3]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 255, 256, 257, 100_000])
def test_checksums_move(n):
    rng = np.random.default_rng(n)
    a, b = rng.bytes(20), rng.bytes(n)
    moved = op._moved(op.move_tables(n), np.array([zlib.crc32(a)], np.uint32))[0]
    assert int(moved) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_payloads_in_order_whatever_the_piece():
    texts = [data.prose(50, i) + " Zz-9 é" for i in range(20)] + [None, ""]
    for limit in (1, 100, 1 << 20):
        found = list(op.payloads(pa.array(texts), limit))
        assert len(found) == 22
        for text, (crc, size) in zip(texts, found, strict=True):
            words = [w.encode() for w in runs(text)[0]]
            assert crc.tolist() == [zlib.crc32(w) for w in words] and size.tolist() == [len(w) for w in words]


def test_gains_in_doubles():
    got = op.gains(np.array([0, 3, 10**12]), np.array([5, 0, 7]))
    s_all, t_all = 10**12 + 3, 12
    assert got.tolist() == [math.floor(1000 * math.log((t + 1.0) * (s_all + 3) / ((s + 1.0) * (t_all + 3)))) for s, t in ((0, 5), (3, 0), (10**12, 7))]
