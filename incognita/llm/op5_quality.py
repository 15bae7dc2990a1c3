"""Quality classifier: multiple-instance learning with gated attention.

A document is a bag of passages. Every passage is encoded, a gated attention network gives each
a weight, and the weighted mean of the codes is scored. Only documents are labelled; which
passages matter is learnt. Features come from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incognita.llm.common import (
    LOWER,
    column,
    mix,
    pieces,
    prefix_hash,
    small_batches,
    span_hash,
    table,
    word_spans,
)

PASSAGE = 48  # words
FIT_ROWS = 4000  # labelled documents the model is fitted on, at most
FIT_PASSAGES = 64  # passages of one of them, evenly spaced, at most; scoring takes all
CUTOFF = 0.7

# every character of a passage falls into one of these bins: letters regardless of case, digits,
# other ASCII characters on their own, control characters, all else
_BIN = np.full(256, 1, np.int64)
_BIN[:32] = 0
_BIN[48:58] = 2
_BIN[LOWER[97:123]] = np.arange(3, 29)
_BIN[65:91] = np.arange(3, 29)
_OTHER = [c for c in range(32, 127) if not chr(c).isalnum()]
_BIN[_OTHER] = np.arange(29, 29 + len(_OTHER))
BINS = 29 + len(_OTHER)
FEATURES = BINS + 8


def passages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, row) of every passage of every row; a row without words has none."""
    start, end, row = word_spans(data, at)
    if not len(start):
        return np.zeros((0, FEATURES), np.float32), np.empty(0, np.int64)
    place = np.arange(len(row)) - np.searchsorted(row, row, "left")
    opens = place % PASSAGE == 0
    first = np.flatnonzero(opens)
    of_word = np.cumsum(opens) - 1
    owner = row[first]
    words = np.diff(np.append(first, len(row)))
    n = len(first)
    # a passage reaches from its first word to the next passage's, or to the end of its row
    begin = start[first]
    stop = np.minimum(np.append(begin[1:], len(data)), at[owner + 1])
    size = (stop - begin).astype(np.float64)
    mark = np.zeros(len(data) + 1, np.int64)
    mark[begin] = 1
    of_byte = np.cumsum(mark)[:-1] - 1
    inside = of_byte >= 0
    inside[inside] &= np.flatnonzero(inside) < stop[of_byte[inside]]
    bins = np.bincount(of_byte[inside] * BINS + _BIN[data[inside]], minlength=n * BINS).reshape(n, BINS)
    upper = (data >= 65) & (data <= 90)
    caps = np.bincount(of_byte[inside & upper], minlength=n)
    length = (end - start).astype(np.float64)
    total = np.bincount(of_word, length, n)
    square = np.bincount(of_word, length**2, n)
    titled = np.bincount(of_word, upper[start], n)
    hashes = span_hash(prefix_hash(LOWER[data]), start, end)
    same = np.zeros(len(row), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    pair = np.zeros(len(row), np.uint64)
    pair[1:] = mix(hashes[1:] + mix(hashes[:-1]))
    pair[place == 0] = 0

    def distinct(values: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of_word))
        v, w = values[order], of_word[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        return np.bincount(w[new], minlength=n)

    mean = total / words
    more = [
        np.log(words),
        mean,
        np.sqrt(np.maximum(square / words - mean**2, 0)),
        caps / size * 10,
        titled / words,
        np.bincount(of_word, same, n) / words,
        distinct(hashes) / words,
        distinct(pair) / words,
    ]
    return np.column_stack([np.sqrt(bins / size[:, None]), *more]).astype(np.float32), owner


@dataclass
class AttentionModel:
    """h = tanh(A x + a); weight ~ exp(w . (tanh(V h) * sigmoid(U h))); score = sigmoid(c . z + d)."""

    parts: dict[str, np.ndarray]
    fitted: bool = True

    CODE, GATE = 24, 12

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, steps: int = 900, batch: int = 128) -> AttentionModel:
        """Mini-batch Adam with a fixed seed. Labels of one kind only give a constant score near 0
        or 1; no labels at all give one half, and ``fitted`` is false."""
        rng = np.random.Generator(np.random.PCG64(7))
        prior = float(np.clip(labels.mean() if len(labels) else 0.5, 0.001, 0.999))
        flat = np.concatenate(bags) if bags else np.zeros((1, FEATURES))

        def init(a: int, b: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(a), (a, b))

        p = {
            "mean": flat.mean(0).astype(float),
            "scale": flat.std(0) + 0.02,
            "A": init(FEATURES, cls.CODE),
            "a": np.zeros(cls.CODE),
            "V": init(cls.CODE, cls.GATE),
            "U": init(cls.CODE, cls.GATE),
            "w": init(cls.GATE, 1)[:, 0],
            "c": np.zeros(cls.CODE),
            "d": np.array(np.log(prior / (1 - prior))),
        }
        model = cls(p, len(labels) > 0)
        if bags and 0.001 < prior < 0.999:
            model._train(bags, labels, rng, steps, batch)
        return model

    def _forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        x = np.clip((x - p["mean"]) / p["scale"], -8, 8)
        h = np.tanh(x @ p["A"] + p["a"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        weight = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(weight[:, None] * h, starts)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))
        return {"x": x, "h": h, "v": v, "u": u, "weight": weight, "z": z, "score": score}

    def _train(self, bags, labels, rng, steps: int, batch: int) -> None:
        p = self.parts
        names = ["A", "a", "V", "U", "w", "c", "d"]
        m = {k: np.zeros_like(p[k]) for k in names}
        s = {k: np.zeros_like(p[k]) for k in names}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(bags), batch)
            sizes = np.array([len(bags[i]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            f = self._forward(np.concatenate([bags[i] for i in pick]), starts, sizes)
            delta = (f["score"] - labels[pick]) / batch
            dz = np.repeat(delta[:, None] * p["c"], sizes, axis=0)
            along = (f["h"] * dz).sum(1)
            de = f["weight"] * (along - np.repeat(np.add.reduceat(f["weight"] * along, starts), sizes))
            dg = de[:, None] * p["w"]
            dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
            dh = f["weight"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T
            da = dh * (1 - f["h"] ** 2)
            grads = {
                "A": f["x"].T @ da + 1e-4 * p["A"],
                "a": da.sum(0),
                "V": f["h"].T @ dv,
                "U": f["h"].T @ du,
                "w": (f["v"] * f["u"]).T @ de,
                "c": f["z"].T @ delta + 1e-4 * p["c"],
                "d": delta.sum(),
            }
            rate = 0.01 * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                s[k] = 0.999 * s[k] + 0.001 * grads[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def scores(self, x: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
        """Score of each of ``rows`` documents; one without words gets 0."""
        out = np.zeros(rows)
        sizes = np.bincount(owner, minlength=rows)
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            out[full] = self._forward(x, starts, sizes[full])["score"]
        return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = []
        for a, b, data, at in pieces(batch.column("text")):
            x, owner = passages(data, at)
            for i in range(b - a):
                own = x[np.searchsorted(owner, i) : np.searchsorted(owner, i, "right")]
                if len(own) > FIT_PASSAGES:
                    own = own[np.linspace(0, len(own) - 1, FIT_PASSAGES).astype(int)]
                cells.append(own.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("label"), pa.array(cells, pa.binary())], ["key", "label", "bag"]
        )


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> AttentionModel:
    """From documents (doc_id, text) and labels (doc_id, label 0/1): the ``rows`` labelled ids
    that come first by hash. Rows without id or label are left out; of an id that occurs more
    than once, the least label and bag count."""
    small_batches(docs.sparkSession)
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy(F.col("doc_id").alias("key"))
    known = known.agg(F.min("label").cast("long").alias("label")).orderBy(F.xxhash64("key"), "key").limit(rows)
    # a bounded number of two-number rows
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("key"))
    bags = chosen.select("key", "label", "text").mapInArrow(_bags, "key long, label long, bag binary")
    bags = bags.groupBy("key").agg(F.min(F.struct("label", "bag")).alias("b")).select("b.*", "key").orderBy("key")
    read = [(r.label, np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES)) for r in bags.collect()]
    read = [(y, x) for y, x in read if len(x)]
    return AttentionModel.fit([x for _, x in read], np.array([float(y) for y, _ in read]))


def score(docs: DataFrame, model: AttentionModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 from the whole text (NULL, blank: 0) in column
    ``name``; a column that has that name is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[column(c) for c in docs.columns if c.lower() != name.lower()])
    schema = T.StructType(list(docs.schema.fields)).add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                model.scores(*passages(data, at), b - a) for a, b, data, at in pieces(batch.column(text))
            ]
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> AttentionModel:
    """Fitted on the labelled rows of ``docs`` that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return fit_model(docs, labels.filter(~held_out(F.col("doc_id"))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole document.

    Texts without words score 0. Repeated rows give repeated rows; a row without doc_id is
    scored like any other and counts as not held out, though nothing is learnt from it.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, quality_model(spark, sf_dir, docs))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= CUTOFF).cast("int").alias("predicted"),
    )
