import zlib

import data
import numpy as np

from incognita.llm import op5_quality as op


def sample(n=400):
    rows, labels = [], []
    for i in range(n):
        good = data.prose(40 + i % 90, i)
        bad = data.prose(60, i) + " " + " ".join(w.upper() + "!!" for w in data.prose(60 + i % 50, i).split())
        rows.append((i, good if i % 3 else bad, "en", "s", 1))
        labels.append((i, 1 if i % 3 else 0))
    return rows, labels


def test_held_out_rows_are_told_apart(spark):
    rows, labels = sample()
    out = op.op5_quality(spark, data.folder(spark, rows, labels)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r.predicted == int(r.doc_id % 3 > 0) for r in out if r.held_out]
    assert len(held) > 60 and np.mean(held) > 0.95


def test_held_out_labels_change_nothing(spark):
    rows, labels = sample(120)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (sorted(data.listed(op.op5_quality(spark, data.folder(spark, rows, x)))) for x in (labels, turned))
    assert a == b


def test_odd_rows_and_tables(spark):
    labels = [(0, 1), (0, 0), (2, 0), (None, 1), (9, 1), (3, None), (99, 1)]
    out = op.op5_quality(spark, data.folder(spark, labels=labels)).collect()
    assert len(out) == len(data.rows())
    blank = [r.score for r in out if r.doc_id in (3, 4, 5)]
    assert blank == [0, 0, 0]
    assert all(r.score == 0.5 for r in op.op5_quality(spark, data.folder(spark)).collect() if r.doc_id in (1, 2, 6))
    assert all(r.score > 0.99 for r in op.op5_quality(spark, data.folder(spark, labels=[(1, 1)])).collect() if r.doc_id in (1, 2))
    assert op.op5_quality(spark, data.folder(spark, [])).collect() == []
    docs = data.documents(spark).withColumnRenamed("lang", "Score")
    assert [c.lower() for c in op.score(docs, op.AttentionModel.fit([], np.empty(0))).columns].count("score") == 1


def test_gradient_of_the_network():
    rng = np.random.Generator(np.random.PCG64(5))
    bags = [rng.normal(size=(k, op.FEATURES)).astype(np.float32) for k in (1, 3, 5, 2)]
    labels = np.array([0.0, 1.0, 1.0, 0.0])
    model = op.AttentionModel.fit(bags, labels, steps=400, batch=4)
    x, owner = np.concatenate(bags), np.repeat(np.arange(4), [1, 3, 5, 2])
    assert np.abs(model.scores(x, owner, 4) - labels).max() < 0.1


def test_passages_do_not_depend_on_the_neighbours():
    texts = [t for _, t, *_ in data.rows() if t and t.split()]
    whole = b"".join(t.encode() for t in texts)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    together, owner = op.passages(np.frombuffer(whole, np.uint8), at)
    for i, t in enumerate(texts):
        one = np.frombuffer(t.encode(), np.uint8)
        alone, _ = op.passages(one, np.array([0, len(one)]))
        assert np.allclose(alone, together[owner == i]) and len(alone) == -(-len(op.word_spans(one, np.array([0, len(one)]))[0]) // op.PASSAGE)
