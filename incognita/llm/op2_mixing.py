"""Mixing to target weights with soft membership.

A classifier, fitted on a labelled table, gives every document a posterior over domains. The
documents' rates are then chosen so that the expected tokens of each domain match their
targets: a document with n tokens and rate r adds r * n * p to a domain with posterior p. Of all
nonnegative rates the ones nearest to 1 are approached by projected gradient steps on the
squared misses; a step takes one pass over (tokens, posteriors), of which only the domains'
totals come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incognita.llm.common import LOWER, column, pieces, small_batches, table, word_spans, written

FIT_ROWS = 4000  # labelled documents the classifier is fitted on, at most
EVIDENCE = 200.0  # byte pairs that a text's mean likelihood counts for, so that posteriors stay soft
STEPS = 40
CLOSE = 1e-4  # largest miss, as a share of the target, at which steps end
PAIRS = 1 << 16


def _pairs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair of neighbouring bytes, row), none across rows; capital letters count as small."""
    low = LOWER[data].astype(np.int32)
    pair = low[:-1] << 8 | low[1:]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    same = row[:-1] == row[1:]
    return pair[same], row[:-1][same]


@dataclass
class DomainModel:
    """Naive Bayes over byte pairs: log P(pair | domain) and log P(domain)."""

    domains: list[str]
    logs: np.ndarray
    prior: np.ndarray
    fitted: bool = True

    def posteriors(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One row per text; an empty one has the prior."""
        rows = len(at) - 1
        pair, row = _pairs(data, at)
        count = np.bincount(row, minlength=rows)
        full = np.flatnonzero(count)
        total = np.zeros((rows, len(self.domains)))
        if len(full):
            starts = np.concatenate([[0], np.cumsum(count[full])[:-1]])
            for k in range(len(self.domains)):
                total[full, k] = np.add.reduceat(self.logs[k][pair], starts)
        total *= (np.minimum(count, EVIDENCE) / np.maximum(count, 1))[:, None]
        total += self.prior
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(domain, pair, n) of the texts of a task; pair -1 counts texts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        domains = batch.column("domain").to_pylist()
        for a, b, data, at in pieces(batch.column("text")):
            pair, row = _pairs(data, at)
            for name in set(domains[a:b]):
                mine = np.array([d == name for d in domains[a:b]])
                into = sums.setdefault(name, np.zeros(PAIRS + 1, np.int64))
                into[:PAIRS] += np.bincount(pair[mine[row]], minlength=PAIRS)
                into[PAIRS] += mine.sum()
    for name, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict(
            {"domain": [name] * len(at), "pair": np.where(at == PAIRS, -1, at), "n": counts[at]}
        )


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], rows: int = FIT_ROWS) -> DomainModel:
    """From documents (doc_id, text) and labels (doc_id, domain): the ``rows`` labelled ids that
    come first by hash. Other domains and rows without id or domain are left out; of an id with
    several labels, the least counts. A domain without samples is unknown: posterior near 0."""
    small_batches(docs.sparkSession)
    known = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # a bounded number of short rows
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("domain", "text")
    counts = chosen.mapInArrow(_counted, "domain string, pair long, n long")
    grid = np.zeros((len(domains), PAIRS))
    texts = np.zeros(len(domains))
    # at most one row per domain and pair
    for r in counts.groupBy("domain", "pair").agg(F.sum("n").alias("n")).collect():
        if r.pair < 0:
            texts[domains.index(r.domain)] = r.n
        else:
            grid[domains.index(r.domain), r.pair] = r.n
    grid += 0.1
    logs = np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32)
    return DomainModel(domains, logs, np.log((texts + 1e-9) / (texts.sum() + 1e-9 * len(domains))), bool(texts.sum()))


def memberships(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` (words of the whole text) and ``posteriors`` in the order of the
    model's domains. Columns of these names are replaced; a NULL text has no tokens."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[column(c) for c in docs.columns if c.lower() not in ("tokens", "posteriors")])
    schema = T.StructType(list(docs.schema.fields)).add("tokens", "long").add("posteriors", T.ArrayType(T.DoubleType()))
    k = len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, shares = [np.empty(0, np.int64)], [np.empty((0, k))]
            for a, b, data, at in pieces(batch.column(text)):
                tokens.append(np.bincount(word_spans(data, at)[2], minlength=b - a))
                shares.append(model.posteriors(data, at))
            flat = np.concatenate(shares).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(tokens)), lists], [*batch.schema.names, "tokens", "posteriors"]
            )

    return docs.mapInArrow(run, schema)


@dataclass
class Rates:
    """Rates as the steps that lead to them: r = max(least, r - posteriors . step), from 1."""

    least: float = 0.0
    steps: list[np.ndarray] = field(default_factory=list)
    totals: np.ndarray | None = None

    def of(self, posteriors: np.ndarray) -> np.ndarray:
        r = np.full(len(posteriors), max(1.0, self.least))
        for g in self.steps:
            r = np.maximum(self.least, r - posteriors @ g)
        return r


def _grid(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def domain_totals(members: DataFrame, rates: Rates, k: int) -> np.ndarray:
    """Expected tokens of each domain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                p = _grid(batch.column("posteriors"))
                sums += (rates.of(p) * batch.column("tokens").to_numpy()) @ p
        yield pa.RecordBatch.from_pydict({"k": np.arange(k, dtype=np.int32), "x": sums})

    out = np.zeros(k)
    for r in members.select("tokens", "posteriors").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r.k] = r.x
    return out


def fit_rates(
    members: DataFrame, weights: list[float], budget: float | None = None, least: float = 0.0, steps: int = STEPS
) -> Rates:
    """Rates, ``least`` or above, by which the domains' expected tokens meet ``weights`` of ``budget``.

    Without a budget the tokens there are count, or, if no rate may be below 1, as many as let every
    domain keep what it has. Misses are divided by the domains' own tokens, which makes steps of
    length 1 safe. A domain without tokens can't be served and is left out.
    """
    k = len(weights)
    rates = Rates(least)
    natural = domain_totals(members, rates, k)
    share = np.array(weights, float) / sum(weights)
    served = natural > 1e-9 * max(natural.sum(), 1e-9)
    if budget is None:
        wanted = served & (share > 0)
        keep = (natural[wanted] / share[wanted]).max(initial=0) if least >= 1 else 0
        budget = max(natural.sum(), keep)
    target = budget * share
    rates.totals = natural
    for _ in range(steps):
        miss = np.where(served, rates.totals - target, 0)
        if (np.abs(miss) <= CLOSE * np.maximum(target, CLOSE * max(budget, 1))).all():
            break
        rates.steps.append(np.where(served, miss / np.where(served, natural, 1), 0))
        rates.totals = domain_totals(members, rates, k)
    return rates


def with_rates(members: DataFrame, rates: Rates) -> DataFrame:
    """``members`` with the ``rate`` of each row."""
    schema = T.StructType(list(members.drop("rate").schema.fields)).add("rate", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = rates.of(_grid(batch.column("posteriors"))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], [*batch.schema.names, "rate"])

    return members.drop("rate").mapInArrow(run, schema)


def drawn(rated: DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """Every row as often as its rate says: the whole part surely, the rest by a hash of key and seed."""
    part = F.pmod(F.xxhash64(column(key), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    times = F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rated.withColumn("rate", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).drop("rate")


def language_labels(spark: SparkSession, sf_dir: str, docs: DataFrame, low: bool = True) -> DataFrame:
    """(doc_id, domain) of labelled documents: their language, or ``low`` where the label says so."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    domain = F.when(F.col("quality") == 1, F.col("lang"))
    if low:
        domain = domain.when(F.col("quality") == 0, "low")
    return docs.select("doc_id", "lang").join(labels, "doc_id").select("doc_id", domain.alias("domain"))


TARGETS = {"en": 0.48, "de": 0.2, "fr": 0.2, "es": 0.1, "low": 0.02}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents by which languages and low-quality text reach their target shares.

    A NULL or empty text has no tokens and the prior as its posterior; it gets a rate like any
    other. Repeated rows get equal rates. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_domains(docs, language_labels(spark, sf_dir, docs), list(TARGETS))
    members = written(memberships(docs.select("doc_id", "text"), model).drop("text"), "members")
    rates = fit_rates(members, list(TARGETS.values()))
    return with_rates(members, rates).select("doc_id", "tokens", "posteriors", "rate")
