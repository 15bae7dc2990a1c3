"""Quality rules on whole documents, with line frequencies across documents.

Lines are normalised and hashed. A line that many different documents of one host carry is no
part of what a document says; it is removed, and a document of which too little stays is
rejected. One pass over the texts takes measures and line hashes; from there on only these are
shuffled, counts being merged in each task first.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incognita.llm.common import column, free_name, small_batches, table, written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
MIN_WORDS = 50
REPEAT_PERCENT = 50
LINE_DOCS = 20  # a line of a host may be in so many different documents, whatever the host's size
LINE_PERCENT = 2  # or in this share of them, if that is more
KEEP_PERCENT = 30  # of its words, a document must keep so many


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = WORDS.findall(text)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif WORDS.search(line):
            seen.add(line)
    repeated = 0
    if len(words) >= 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            hits = np.zeros(len(words) + 1, np.int64)  # how many repeated windows cover a word
            at = np.array([i for i, w in enumerate(windows) if counts[w] > 1])
            np.add.at(hits, at, 1)
            np.add.at(hits, np.minimum(at + 3, len(words)), -1)
            repeated = int(np.count_nonzero(np.cumsum(hits)[: len(words)]))
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), dup_lines, repeated


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NORMAL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def line_hash(line: str) -> tuple[int, int]:
    """(hash, words) of a normalised line: small letters, digits as 0, single blanks; 0 words: blank."""
    words = WORDS.findall(line)
    return _hash(" ".join(words).translate(NORMAL)), len(words)


def line_words(text: str) -> dict[int, int]:
    """Words that each different line of the text takes up, over all its occurrences."""
    out: dict[int, int] = {}
    for line in text.split("\n"):
        key, n = line_hash(line)
        if n:
            out[key] = out.get(key, 0) + n
    return out


_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *rest, texts = batch.columns
        values = [t or "" for t in texts.to_pylist()]
        cells = [measures(t) for t in values]
        columns = [pa.array([c[i] for c in cells], pa.int64()) for i in range(len(MEASURES))]
        columns.append(pa.array([_hash(t) for t in values], pa.int64()))
        columns.append(pa.array([[{"line": k, "words": n} for k, n in line_words(t).items()] for t in values], _LINES))
        names = [*batch.schema.names[:-1], *MEASURES, "text_hash", "lines"]
        yield pa.RecordBatch.from_arrays([*rest, *columns], names=names)


def frequent_lines(lines: DataFrame) -> DataFrame:
    """(host, line) of lines above the limit of their host, from (host, text_hash, line)."""
    docs = lines.select("host", "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LINE_DOCS)
    above = counts.join(docs, "host").filter(F.col("n") * 100 > F.col("docs") * LINE_PERCENT)
    return above.select("host", "line")


def judge(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` without its text, with the measures, ``base_failed``, ``kept_words`` (words in
    lines that stay), ``kept`` and ``cut_lines`` (hashes of its lines above the limit, for ``strip``).

    Documents of a host with the same text count once, so copies alone make no line frequent.
    NULL as host is a host like any other; a NULL or blank text has no words and fails. Columns of
    the frame that have a name this adds are replaced; an empty frame gives an empty one.
    """
    small_batches(docs.sparkSession)
    added = {*MEASURES, "base_failed", "kept_words", "kept", "cut_lines", "text_hash", "lines"}
    rest = [c for c in docs.columns if c != text and c.lower() not in added]
    key = free_name(docs, "host_key")
    hosted = docs.select(
        *[column(c) for c in rest], F.coalesce(F.concat(F.lit("="), column(host).cast("string")), F.lit("")).alias(key), column(text)
    )
    schema = hosted.drop(text).schema
    for name in (*MEASURES, "text_hash"):
        schema = schema.add(name, "long")
    schema = schema.add("lines", T.ArrayType(T.StructType().add("line", "long").add("words", "long")))
    measured = written(hosted.mapInArrow(_measured, schema), "measures")

    # each text of a host once: all its copies lose the same lines
    lines = measured.select(column(key).alias("host"), "text_hash", F.explode("lines").alias("l"))
    lines = lines.select("host", "text_hash", "l.line", "l.words").distinct()
    lines = written(lines, "lines")
    cut = lines.join(frequent_lines(lines.drop("words")), ["host", "line"]).groupBy("host", "text_hash")
    cut = cut.agg(F.sum("words").alias("cut_words"), F.sort_array(F.collect_list("line")).alias("cut_lines"))
    cut = cut.withColumnsRenamed({"host": key, "text_hash": "text_hash"})

    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * n)
    stays = n - F.coalesce("cut_words", F.lit(0))
    out = measured.join(cut, [key, "text_hash"], "left")
    return out.select(
        *[column(c) for c in rest],
        *MEASURES,
        failed.alias("base_failed"),
        stays.alias("kept_words"),
        (~failed & (100 * stays >= KEEP_PERCENT * n)).alias("kept"),
        "cut_lines",
    )


def strip(docs: DataFrame, text: str = "text", cut: str = "cut_lines") -> DataFrame:
    """``docs`` with the lines whose hashes ``cut`` lists taken out of the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, hashes in zip(batch.column(text).to_pylist(), batch.column(cut).to_pylist(), strict=True):
                if value and hashes:
                    gone = set(hashes)
                    value = "\n".join(x for x in value.split("\n") if line_hash(x)[0] not in gone)
                out.append(value)
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for every whole document; its source is the host."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", *MEASURES, "base_failed", "kept", "kept_words")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), rw AS (
  SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), ln AS (
  SELECT r, host, t, l, row_number() OVER (PARTITION BY r, l ORDER BY k) AS nth, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT r, host, t, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d)
), dl AS (SELECT r, count(*) AS n FROM ln WHERE nth > 1 AND len(lw) > 0 GROUP BY r),
norm AS (
  SELECT r, host, t, len(lw) AS words, translate(array_to_string(lw, ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS line FROM ln WHERE len(lw) > 0
), hosts AS (SELECT host, count(DISTINCT t) AS docs FROM norm GROUP BY host),
often AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS n FROM norm GROUP BY host, line) JOIN hosts USING (host)
  WHERE n > 20 AND n * 100 > docs * 2
), cut AS (SELECT r, sum(words) AS n FROM norm JOIN often USING (host, line) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
    coalesce(rw.n, 0)::BIGINT AS n_repeat_words, (len(w) - coalesce(cut.n, 0))::BIGINT AS kept_words
  FROM d LEFT JOIN rw USING (r) LEFT JOIN dl USING (r) LEFT JOIN cut USING (r)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * kept_words >= 30 * n_words AS kept FROM f
"""
