"""Removal of repeated substrings: interval expansion on a Burrows-Wheeler transform.

Equal strings have to meet in one task. Every window of LENGTH bytes has an anchor, the least
hash of the short strings in it; equal windows have equal anchors, and consecutive windows with
one anchor form a segment. A segment whose anchor occurs nowhere else can't repeat; one that is
equal to another as a whole repeats as a whole; both need no bytes. Only different segments
with one anchor, each once, are read again and gathered by anchor.

There a suffix array of the gathered bytes gives the transform, and the common prefixes of
neighbouring suffixes are derived from it by increasing value: a boundary with common prefix v
yields, one symbol to the left, boundaries with v + 1. It stops at LENGTH - 1: what has no value by
then shares LENGTH bytes or more with its neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from incognita.llm.common import mix, pieces, powers, prefix_hash, small_batches, span_hash, table, written

LENGTH = 400
ANCHOR = 100  # bytes of the strings that anchors are chosen from
GATHER = 1 << 20  # bytes that a task gathers, about
HOT = 1 << 20  # bytes of different segments with one anchor from which its windows are dealt out singly


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values."""
    n = len(values)
    grid = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    last = n - width + 1
    return np.minimum(behind[:last], ahead[width - 1 : width - 1 + last])


def segments(data: np.ndarray, at: np.ndarray, length: int, anchor: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, of every row: row, start (in the row), windows, anchor,
    hash of the run's bytes, and whether its anchor occurs in it more than once."""
    empty = {k: np.empty(0, np.int64) for k in ("row", "start", "windows", "anchor", "seg")}
    if len(data) < length or not (np.diff(at) >= length).any():
        return empty | {"multi": np.empty(0, bool)}
    sums = prefix_hash(data)
    n = len(data)
    _, down = powers(n)
    hashes = mix((sums[anchor:] - sums[: n - anchor + 1]) * down[: n - anchor + 1])
    least = sliding_min(hashes, length - anchor + 1)  # one for each window of the piece
    valid = np.zeros(len(least) + 1, np.int64)
    fits = np.flatnonzero(np.diff(at) >= length)
    np.add.at(valid, at[fits], 1)
    np.add.at(valid, at[fits + 1] - length + 1, -1)
    valid = np.cumsum(valid)[:-1] > 0
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    new[at[fits]] = True
    start = np.flatnonzero(new)
    row = np.searchsorted(at, start, "right") - 1
    stop = np.minimum(np.append(start[1:], len(least)), at[row + 1] - length + 1)
    # the window behind an occurrence has the same least hash: there is another occurrence
    own = np.concatenate([[0], np.cumsum(hashes[: len(least)] == least)])
    return {
        "row": row,
        "start": start - at[row],
        "windows": stop - start,
        "anchor": least[start].view(np.int64),
        "seg": span_hash(sums, start, stop - 1 + length).view(np.int64),
        "multi": own[stop - 1] > own[start],
    }


def _segments(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark = batch.column("doc"), batch.column("mark")
            for a, _, data, at in pieces(batch.column("text")):
                s = segments(data, at, length, anchor)
                rows = pa.array(s["row"] + a)
                yield pa.RecordBatch.from_arrays(
                    [doc.take(rows), mark.take(rows), *(pa.array(s[k]) for k in ("start", "windows", "anchor", "seg", "multi"))],
                    ["doc", "mark", "start", "windows", "anchor", "seg", "multi"],
                )

    return run


# --- the transform of the gathered segments ------------------------------------------------


def suffix_array(text: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, place of each suffix); the last symbol of ``text`` occurs once.

    Sorted by as many symbols as fit a number, then by twice as many each round, where only
    suffixes that are still alike are sorted again.
    """
    n = len(text)
    bits = max(1, int(symbols).bit_length())
    width = min(n, max(1, 62 // bits))
    key = np.zeros(n, np.int64)
    for j in range(width):
        key <<= bits
        key[: n - j] |= text[j:]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        alike = ~new
        alike[:-1] |= ~new[1:]
        at = np.flatnonzero(alike)
        if not len(at):
            return order, rank
        own = order[at]
        key = rank[own] * (n + 1) + rank[np.minimum(own + width, n - 1)]
        by = np.argsort(key, kind="stable")
        key, own = key[by], own[by]
        order[at] = own
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        new[at] = first
        rank[own] = np.maximum.accumulate(np.where(first, at, 0))
        width *= 2


def repeated_starts(parts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each byte string, where strings of ``length`` bytes start that also start elsewhere."""
    count = len(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.empty(int(sizes.sum()) + count, np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:count]
    for i, p in enumerate(parts):  # each part ends with a symbol of its own
        text[begin[i] : begin[i] + len(p)] = p.astype(np.int64) + count
        text[begin[i] + len(p)] = i
    order, place = suffix_array(text, count + 256)
    n = len(text)
    first = text[order]
    boundary = np.ones(n, bool)
    boundary[1:] = first[1:] != first[:-1]
    # a boundary inside one symbol's suffixes is the image of those between the two suffixes
    # that follow the symbol; if these are neighbours, of a single one
    open_ = np.flatnonzero(~boundary)
    low, high = place[order[open_ - 1] + 1], place[order[open_] + 1]
    single = high == low + 1
    image = np.full(n, -1, np.int64)
    image[high[single]] = open_[single]
    some, low, high = open_[~single], low[~single], high[~single]
    front = np.flatnonzero(boundary)
    value = 0
    while len(front) and value < length - 1:
        reached = image[front]
        reached = reached[reached >= 0]
        if len(some):
            if len(some) * 8 > n:
                marks = np.zeros(n + 1, np.int32)
                marks[front + 1] = 1
                marks = np.cumsum(marks)
                hit = marks[high + 1] > marks[low + 1]
            else:
                front = np.sort(front)
                hit = np.searchsorted(front, high, "right") > np.searchsorted(front, low, "right")
            reached = np.concatenate([reached, some[hit]])
            some, low, high = some[~hit], low[~hit], high[~hit]
        value += 1
        boundary[reached] = True
        front = reached
    deep = np.flatnonzero(~boundary)
    found = np.zeros(n, bool)
    found[order[deep]] = True
    found[order[deep - 1]] = True
    return [np.flatnonzero(found[b : b + s]) for b, s in zip(begin, sizes, strict=True)]


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, behind last) of the runs of consecutive numbers."""
    if not len(places):
        return places, places
    gap = np.flatnonzero(np.diff(places) > 1)
    return places[np.concatenate([[0], gap + 1])], places[np.concatenate([gap, [len(places) - 1]])] + 1


def _expand(length: int):
    def run(gathered: pa.Table) -> pa.Table:
        seen: dict[tuple[int, int], np.ndarray] = {}
        for a, s, b in zip(*(gathered.column(c).to_pylist() for c in ("anchor", "seg", "bytes")), strict=True):
            seen.setdefault((a, s), np.frombuffer(b, np.uint8))
        out: dict[str, list] = {"anchor": [], "seg": [], "low": [], "high": []}
        for (a, s), starts in zip(seen, repeated_starts(list(seen.values()), length), strict=True):
            low, high = runs(starts)
            out["anchor"] += [a] * len(low)
            out["seg"] += [s] * len(low)
            out["low"] += low.tolist()
            out["high"] += high.tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def _cut(length: int):
    """The wanted segments of each document, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("wanted"), strict=True):
                whole = memoryview(text.cast(pa.binary()).as_buffer())
                rows = wanted.as_py()
                cells = [bytes(whole[w["start"] : w["start"] + w["windows"] - 1 + length]) for w in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([w[c] for w in rows], pa.int64()) for c in ("bucket", "anchor", "seg")),
                        pa.array(cells, pa.binary()),
                    ],
                    ["bucket", "anchor", "seg", "bytes"],
                )

    return run


def _windows(length: int):
    """Two hashes of every window of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, seg, cell in zip(*(batch.column(c) for c in ("anchor", "seg", "bytes")), strict=True):
                data = np.frombuffer(cell.as_py(), np.uint8)
                low = np.arange(len(data) - length + 1)
                one = span_hash(prefix_hash(data), low, low + length).view(np.int64)
                two = span_hash(prefix_hash(data ^ np.uint8(255)), low, low + length).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(low), x.as_py())) for x in (anchor, seg)] + [pa.array(x) for x in (low, one, two)],
                    ["anchor", "seg", "low", "one", "two"],
                )

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_chars", "spans")}
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            whole = memoryview(text.cast(pa.binary()).as_buffer()) if text.is_valid else memoryview(b"")
            merged: list[list[int]] = []
            for s in sorted((s["low"], s["high"]) for s in spans.as_py() or []):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            digest, kept, at = hashlib.sha256(), [], 0
            for a, b in [*merged, [len(whole), len(whole)]]:
                digest.update(whole[at:a])
                kept.append(str(whole[at:a], "utf-8", "ignore"))  # a character that is cut in two goes
                at = b
            left = "".join(kept)
            cells["n_bytes"].append(len(whole))
            cells["n_removed"].append(sum(b - a for a, b in merged))
            cells["n_spans"].append(len(merged))
            cells["kept_sha256"].append(digest.hexdigest())
            cells["text"].append(left)
            cells["n_chars"].append(len(left))
            cells["spans"].append([{"low": a, "high": b} for a, b in merged])
        kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64(), _SPANS]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(cells.values(), kinds, strict=True))],
            ["doc_id", *cells],
        )


_SPANS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, gather: int = GATHER, hot_bytes: int = HOT
) -> DataFrame:
    """(doc, mark, spans) for documents (doc, mark, text) with bytes in repeated strings.

    ``doc`` and ``mark`` together name a row and are not NULL; spans (low, high) count bytes and
    may overlap.
    """
    small_batches(docs.sparkSession)
    kinds = "doc long, mark long, start long, windows long, anchor long, seg long, multi boolean"
    segs = written(docs.select("doc", "mark", "text").mapInArrow(_segments(length, anchor), kinds), "segments")
    anchors = segs.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("seg").alias("s0"), F.max("seg").alias("s1"), F.max("multi").alias("multi")
    )
    anchors = anchors.filter("n > 1 OR multi").select("anchor", (F.expr("s0 <> s1 OR multi")).alias("varied"))
    segs = written(segs.drop("multi").join(anchors, "anchor"), "segments")
    varied = segs.filter("varied")

    # each different segment once; copies of one repeat as a whole
    kinds = varied.groupBy("anchor", "seg", "windows").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "mark", "start")).alias("at")
    )
    kinds = written(kinds.select("anchor", "seg", "windows", "n", "at.*"), "kinds")
    per_anchor = kinds.groupBy("anchor").agg(F.sum(F.col("windows") + (length - 1)).alias("bytes"))
    per_anchor = written(per_anchor, "anchors")
    total = per_anchor.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-total // gather))
    bucket = F.when(F.col("bytes") > hot_bytes, -1).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    wanted = kinds.join(per_anchor.select("anchor", bucket.alias("bucket")), "anchor")
    wanted = wanted.groupBy("doc", "mark").agg(
        F.collect_list(F.struct("start", "windows", "anchor", "seg", "bucket")).alias("wanted")
    )
    cut = docs.select("doc", "mark", "text").join(wanted, ["doc", "mark"]).select("text", "wanted")
    cut = written(cut.mapInArrow(_cut(length), "bucket long, anchor long, seg long, bytes binary"), "gathered")
    marks = "anchor long, seg long, low long, high long"
    deep = cut.filter("bucket >= 0").groupBy("bucket").applyInArrow(_expand(length), marks)

    # anchors with very many different segments: their windows are counted one by one, anywhere
    single = cut.filter("bucket < 0").dropDuplicates(["anchor", "seg"])
    single = single.mapInArrow(_windows(length), "anchor long, seg long, low long, one long, two long")
    single = written(single, "windows")
    again = single.groupBy("anchor", "one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    hot = written(single.join(again, ["anchor", "one", "two"]).select("anchor", "seg", "low").distinct(), "windows")
    run = F.col("low") - F.row_number().over(Window.partitionBy("anchor", "seg").orderBy("low"))
    hot = hot.withColumn("run", run).groupBy("anchor", "seg", "run").agg(F.min("low").alias("low"), (F.max("low") + 1).alias("high"))

    found = written(deep, "marks").unionByName(written(hot.drop("run"), "marks"))
    found = found.unionByName(kinds.filter("n > 1").select("anchor", "seg", F.lit(0).cast("long").alias("low"), F.col("windows").alias("high")))
    first = F.col("start") + F.col("low")
    spans = varied.join(found, ["anchor", "seg"]).select(
        "doc", "mark", first.alias("low"), (F.col("start") + F.col("high") + (length - 1)).alias("high")
    )
    whole = segs.filter("NOT varied").select(
        "doc", "mark", F.col("start").alias("low"), (F.col("start") + F.col("windows") + (length - 1)).alias("high")
    )
    return spans.unionByName(whole).groupBy("doc", "mark").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def without_repeats(
    docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, gather: int = GATHER, hot_bytes: int = HOT
) -> DataFrame:
    """For documents (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, the ``text``
    that is left, without characters of which a byte was removed, its code points (n_chars), and
    ``spans``, the removed runs of bytes (low, high).

    A NULL text counts as empty; texts below ``length`` bytes keep all; rows that are repeated as
    they are count as occurrences of each other. An empty table gives no rows.
    """
    keyed = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc"),
        F.xxhash64("text").alias("mark"),
        "text",
    )
    spans = written(repeated_spans(keyed, length, anchor, gather, hot_bytes), "spans")
    joined = keyed.join(spans, ["doc", "mark"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(
        _removed,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, n_chars long, spans array<struct<low:long,high:long>>",
    )


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that occur more than once, and what is left."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_chars")


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS g FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM s) WHERE c > 1),
st AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM rep),
sp AS (SELECT r, g, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM st) GROUP BY r, g),
gap AS (
  SELECT r, a, b, substr(h, 2 * before + 1, 2 * (a - before)) AS k
  FROM (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM sp) JOIN d USING (r)
  UNION ALL SELECT r, len(h) // 2 + 1, NULL, substr(h, 2 * coalesce(e, 0) + 1) FROM d LEFT JOIN (SELECT r, max(b) AS e FROM sp GROUP BY r) USING (r)
),
f AS (
  SELECT r, count(b) AS n, coalesce(sum(b - a), 0) AS x, string_agg(k, '' ORDER BY a) AS k,
    decode(unhex(string_agg(regexp_replace(regexp_replace(k, '^([89AB][0-9A-F])+', ''), '([CDEF][0-9A-F]|E[0-9A-F][89AB][0-9A-F]|F[0-9A-F]([89AB][0-9A-F]){1,2})$', ''), '' ORDER BY a))) AS t
  FROM gap GROUP BY r
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, x::BIGINT AS n_removed, n::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256, t AS text, len(t)::BIGINT AS n_chars
FROM d JOIN f USING (r)
"""
