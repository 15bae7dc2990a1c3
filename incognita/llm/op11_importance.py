"""Importance resampling towards a target: hashed n-gram counts by way of a word automaton.

A batch of texts gives a dictionary of its different words, each between two delimiters, with the
word's CRC-32 and length as payload. One scan of an Aho-Corasick automaton over the texts emits the
payloads in order. CRC-32 is linear: the checksum of two strings joined is that of the first,
moved on by the length of the second, xor that of the second. So payloads of neighbours compose to
the checksums of runs of words, and no run is ever spelt out. The payloads are written once; one
pass over them counts buckets, a second one sums each document's gains.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incognita.llm.common import column, free_name, pieces, small_batches, table, text_bytes, written
from incognita.llm.op1_sharding import positions

BUCKETS = 10_000
NGRAM = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
KEPT_LENGTHS = 256  # lengths of words whose tables are kept
PIECE = 1 << 18  # bytes of text that one automaton serves, about (it should fit a processor's cache)
_BLANK = np.uint32(zlib.crc32(b" "))

# ASCII other than digits and letters delimits words; letters are lower-cased
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _moved(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Checksums moved on by the number of bytes that the four ``tables`` stand for."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@cache
def _one_byte() -> np.ndarray:
    """Tables (byte of the checksum, its value) for one more zero byte."""
    low = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        low = np.where(low & 1, low >> 1 ^ np.uint32(0xEDB88320), low >> 1)
    byte = np.arange(256, dtype=np.uint32)
    return np.stack([low, byte, byte << 8, byte << 16])


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.stack([_moved(second, t) for t in first])


_lengths: dict[int, np.ndarray] = {}


def move_tables(n: int) -> np.ndarray:
    """Tables for ``n`` more bytes, by repeated doubling; those of usual words are kept."""
    if n in _lengths:
        return _lengths[n]
    byte = np.arange(256, dtype=np.uint32)
    out, power, left = np.stack([byte, byte << 8, byte << 16, byte << 24]), _one_byte(), n
    while left:
        if left & 1:
            out = _then(out, power)
        power, left = _then(power, power), left >> 1
    if n <= KEPT_LENGTHS:
        _lengths[n] = out
    return out


class Lexicon:
    """An automaton over different words; their payloads are CRC-32 and length in bytes."""

    def __init__(self, words: list[str]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(words):
            self.automaton.add_word(f" {w} ", i)
        if words:
            self.automaton.make_automaton()
        raw = [w.encode() for w in words]
        self.crc = np.array([zlib.crc32(w) for w in raw], np.uint32)
        self.size = np.array([len(w) for w in raw], np.uint32)

    def scan(self, text: str) -> np.ndarray:
        """Numbers of the words of ``text`` (a blank around each), in order."""
        return np.fromiter(map(itemgetter(1), self.automaton.iter(text)), np.int64) if len(self.crc) else np.empty(0, np.int64)


def payloads(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(checksums, lengths) of the words of each text in turn; a lexicon serves about ``limit`` bytes."""
    for _, _, data, at in pieces(texts, limit):
        folded = data.tobytes().translate(_FOLD)
        rows = [f" {folded[a:b].decode()} " for a, b in zip(at[:-1], at[1:], strict=True)]
        lexicon = Lexicon(list({w for r in rows for w in r.split(" ")} - {""}))
        for r in rows:
            word = lexicon.scan(r)
            yield lexicon.crc[word], lexicon.size[word]


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the payloads of its words in place of the text: ``crcs`` (four bytes each) and
    ``sizes`` (one byte each, or four where a text has a word of 256 bytes or more)."""
    small_batches(df.sparkSession)
    names = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in names]).add("crcs", T.BinaryType()).add("sizes", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, sizes = [], []
            for crc, size in payloads(batch.column(0)):
                crcs.append(crc.astype("<u4").tobytes())
                sizes.append(size.astype("u1" if size.max(initial=0) < 256 else "<u4").tobytes())
            arrays = [*batch.columns[1:], pa.array(crcs, pa.binary()), pa.array(sizes, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "crcs", "sizes"])

    return df.select(column(text), *[column(c) for c in names]).mapInArrow(run, schema)


def unscanned(crcs: pa.Array, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(checksums, lengths, words of each row) from the two columns of ``scanned``."""
    data, at = text_bytes(crcs)
    counts = np.diff(at) // 4
    narrow, ends = text_bytes(sizes)
    parts = [narrow[a:b] if b - a == n else narrow[a:b].view("<u4") for a, b, n in zip(ends[:-1], ends[1:], counts, strict=True)]
    size = np.concatenate([p.astype(np.uint32) for p in parts]) if parts else np.empty(0, np.uint32)
    return data[at[0] : at[-1]].view("<u4"), size, counts


Runs = list[tuple[np.ndarray, np.ndarray]]


def composed(crc: np.ndarray, size: np.ndarray, row: np.ndarray, buckets: int = BUCKETS, ngram: int = NGRAM) -> Runs:
    """Per length of run (row, bucket) of every run of words, from the payloads alone."""
    lengths, kind = np.unique(size, return_inverse=True)
    tab = np.stack([move_tables(int(n)) for n in lengths]) if len(lengths) else np.empty((0, 4, 256), np.uint32)
    byte, word = _one_byte()[0], crc
    out, start = [(row, crc % np.uint32(buckets))], np.arange(len(word))
    for n in range(1, ngram):  # runs of n words, each with the word that follows in the same text
        goes_on = start + n < len(word)
        goes_on[goes_on] = row[start[goes_on]] == row[start[goes_on] + n]
        start = start[goes_on]
        last, crc = start + n, crc[goes_on]
        crc = crc >> 8 ^ byte[crc & 255] ^ _BLANK
        t = kind[last]
        crc = tab[t, 0, crc & 255] ^ tab[t, 1, crc >> 8 & 255] ^ tab[t, 2, crc >> 16 & 255] ^ tab[t, 3, crc >> 24] ^ word[last]
        out.append((row[start], crc % np.uint32(buckets)))
    return out


def bucket_counts(scans: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM) -> np.ndarray:
    """How many features of all rows fall into each bucket. A task returns one row a bucket at most."""
    small_batches(scans.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            crc, size, counts = unscanned(batch.column(0), batch.column(1))
            for _, bucket in composed(crc, size, np.repeat(np.arange(len(counts)), counts), buckets, ngram):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = scans.select("crcs", "sizes").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # as many rows as buckets, at most
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket floor(1000 ln of the smoothed share in the target over that in the corpus)."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    each = zip(corpus.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in each], np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, the same for a document at every call."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(scans: DataFrame, gain: np.ndarray, key: str = "doc_id", seed: int = SEED, ngram: int = NGRAM) -> DataFrame:
    """Rows of ``scanned`` without their payloads, with n_words, n_features, weight and score (NULL without a key)."""
    small_batches(scans.sparkSession)
    own = ["n_words", "n_features", "weight", "score"]
    names = [c for c in scans.columns if c not in ("crcs", "sizes")]
    schema = T.StructType([scans.schema[c] for c in names])
    for c in own:
        schema = schema.add(c, T.LongType())
    at, buckets = names.index(key), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, size, words = unscanned(batch.column(0), batch.column(1))
            n = len(batch)
            feats, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for row, bucket in composed(crc, size, np.repeat(np.arange(n), words), buckets, ngram):
                ends = np.searchsorted(row, np.arange(n + 1))
                feats += np.diff(ends)
                weight += np.diff(np.append(0, np.cumsum(gain[bucket]))[ends])
            keys = batch.column(2 + at).to_pylist()
            score = [None if k is None else int(w) + noise(k, seed) for k, w in zip(keys, weight, strict=True)]
            arrays = [*batch.columns[2:], pa.array(words), pa.array(feats), pa.array(weight), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *own])

    return scans.select("crcs", "sizes", *[column(c) for c in names]).mapInArrow(run, schema)


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, ngram: int = NGRAM,
) -> DataFrame:
    """All rows of ``docs`` without their texts, with n_features, weight, score and rank.

    Of the N rows with at least ``least_words`` words floor(percent * N / 100) are drawn, by score,
    then key; they have a rank from 1, the others NULL. NULL and empty texts have no features and
    weight 0. Rows without a key have no score and are drawn last. Rows that are repeated are ranked
    one by one, in any order among themselves. An empty table gives no rows, an empty target the
    smoothed shares of nothing. Columns of the frame named as these four are replaced.
    """
    own = ["n_words", "n_features", "weight", "score", "rank", "crcs", "sizes"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in own and c not in (text, key)])
    scans = written(scanned(docs, text), "payloads")
    wanted = scanned(target.select(column(text)), text)
    gain = gains(bucket_counts(scans, buckets, ngram), bucket_counts(wanted, buckets, ngram))
    scored = written(weighed(scans, gain, key, seed, ngram), "scored")
    place, low, late = (free_name(scored, x) for x in ("place", "low", "late"))
    able = scored.filter(F.col("n_words") >= least_words)
    able = able.withColumn(low, F.coalesce(-F.col("score"), F.lit((1 << 63) - 1))).withColumn(late, column(key).isNull())
    # equal rows are told apart by their number in the file, so that a key with very many rows spreads
    order = [low, late, key, "n_features", "weight"]
    tie = free_name(able, "tie")
    able = able.withColumn(tie, F.monotonically_increasing_id())
    placed, total = positions(able, [*order, tie], place)
    rank = F.when(column(place) < percent * total // 100, column(place) + 1).cast("long")
    drawn = placed.withColumn("rank", rank).drop(place, low, late, tie)
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("n_words")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 5 % of them drawn towards the benchmark's texts; see ``resample`` for odd rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = resample(docs, table(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i))),
w AS MATERIALIZED (
  SELECT kind, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 's' AS kind, row_number() OVER () AS r, doc_id, text FROM documents
        UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark)),
f AS MATERIALIZED (
  SELECT kind, r, array_to_string(w[i : i + n - 1], ' ') AS f FROM (
    SELECT kind, r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3]) AS n))),
g AS MATERIALIZED (SELECT kind, r, f, count(*) AS n FROM f GROUP BY ALL),
b AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(len(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT),
    lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]), 4294967295), 4294967295) % 10000 AS b
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM g)), tab),
c AS (SELECT b, coalesce(sum(n) FILTER (kind = 's'), 0) AS s, coalesce(sum(n) FILTER (kind = 't'), 0) AS t FROM g JOIN b USING (f) GROUP BY b),
a AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM c),
q AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM c, a),
x AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM g JOIN b USING (f) JOIN q USING (b) WHERE kind = 's' GROUP BY r),
y AS (
  SELECT w.doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN x USING (r) WHERE kind = 's'),
z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC NULLS LAST, doc_id NULLS LAST, n_features, weight) AS p FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND p <= 5 * (SELECT count(*) FROM y WHERE able) // 100 THEN p END AS rank FROM z
"""
