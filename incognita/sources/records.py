"""Records that may go on over several lines, read in parallel.

Whether a line end inside a split ends a record depends on what stands before the split: it may
lie in a quoted literal. So each split is first read under every possible state at its start,
which gives a function of that state (one row a split); composing these functions along each
file fixes the states. Then every split cuts its own records, and only the lines before its first
and behind its last record end, which belong to records across splits, are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.session import shared_dir

SPLITS_AT_ONCE = 1_000_000  # rows of 36 bytes up to which the splits' states are broadcast
BATCH_ROWS, BATCH_BYTES = 2000, "16m"


@dataclass(frozen=True)
class Lexer:
    """States 0 … ``states`` - 1, of which 0 is the one between records."""

    states: int
    step: Callable[[int, str], int]  # (state before a line, line) to the state behind its end
    ends: Callable[[str], bool]  # whether a line behind which the state is 0 ends a record


_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _csv_step(state: int, line: str) -> int:
    """Quotes open and close; a quote behind a backslash does neither."""
    if '"' not in line:
        return state
    return state ^ (_ESCAPED.sub("", line) if "\\" in line else line).count('"') & 1


CSV_LEXER = Lexer(2, _csv_step, lambda line: True)

# between literals, in the three kinds of quotes, in a comment of several lines
_BETWEEN = re.compile(
    r"""(?:[^'"`#/-]++|'(?:[^'\\]++|\\.|'')*+'|"(?:[^"\\]++|\\.|"")*+"|`[^`]*+`|--.*+|\#.*+|/\*(?:[^*]++|\*(?!/))*+\*/|-(?!-)|/(?!\*))*+""",
    re.DOTALL,
)
_OPENED = {"'": 1, '"': 2, "`": 3, "/": 4}
_CLOSED = {
    1: re.compile(r"(?:[^'\\]++|\\.|'')*+'", re.DOTALL),
    2: re.compile(r'(?:[^"\\]++|\\.|"")*+"', re.DOTALL),
    3: re.compile(r"[^`]*+`"),
    4: re.compile(r"(?:[^*]++|\*(?!/))*+\*/", re.DOTALL),
}
_STATEMENT_END = re.compile(r";[ \t\r]*$")


def _dump_step(state: int, line: str) -> int:
    at = 0
    if state:
        closed = _CLOSED[state].match(line)
        if closed is None:
            return state
        at = closed.end()
    at = _BETWEEN.match(line, at).end()
    return _OPENED[line[at]] if at < len(line) else 0


DUMP_LEXER = Lexer(5, _dump_step, lambda line: _STATEMENT_END.search(line) is not None)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, value) of every line, in order within a split."""
    conf = spark.conf
    if conf.get("spark.sql.files.minPartitionNum", None) is None:  # splits must be the same in every pass
        conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.text(path, lineSep="\n").select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )


Key = tuple[int, int]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Key, list[int], list[str]]]:
    """Consecutive lines of one split: its key, their ids, their texts."""
    for batch in batches:
        file, block, ids, values = (batch.column(c).to_pylist() for c in ("file", "block", "id", "value"))
        a = 0
        for b in range(1, len(file) + 1):
            if b == len(file) or file[b] != file[a] or block[b] != block[a]:
                yield (file[a], block[a]), ids[a:b], values[a:b]
                a = b


_SUMMARY = "file long, block long, after array<int>, first array<long>, last array<long>"


def _summaries(lexer: Lexer):
    """Per split and state at its start: the state at its end, the first and the last line that
    ends a record (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for key, ids, values in _runs(batches):
            if not rows or rows[-1][:2] != list(key):
                rows.append([*key, list(range(lexer.states)), [-1] * lexer.states, [-1] * lexer.states])
            _, _, after, first, last = rows[-1]
            for at, line in zip(ids, values, strict=True):
                moved = {s: lexer.step(s, line) for s in set(after)}
                done = 0 in moved.values() and lexer.ends(line)
                for s in range(lexer.states):
                    after[s] = moved[after[s]]
                    if done and after[s] == 0:
                        last[s] = at
                        if first[s] < 0:
                            first[s] = at
        cells = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        arrays = [pa.array(list(c), k) for c, k in zip(cells, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["file", "block", "after", "first", "last"])

    return run


def _scanned(splits: pa.Table) -> pa.Table:
    """The state at each split's start fixed along one file, and the record its first lines are of."""
    rows, state, record = [], 0, 0
    for s in splits.sort_by("block").to_pylist():
        first, last = s["first"][state], s["last"][state]
        rows.append({"file": s["file"], "block": s["block"], "first": first, "last": last, "record": record})
        record += last >= 0
        state = s["after"][state]
    return pa.Table.from_pylist(rows, schema=pa.schema([(c, pa.int64()) for c in ("file", "block", "first", "last", "record")]))


def _cut(lexer: Lexer):
    """Records that lie within a split; they begin in state 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []
        state = 0
        for batch in batches:
            file, block, at, record = [], [], [], []
            for key, ids, values in _runs([batch]):
                for i, line in zip(ids, values, strict=True):
                    waiting.append(line)
                    state = lexer.step(state, line)
                    if state == 0 and lexer.ends(line):
                        file.append(key[0])
                        block.append(key[1])
                        at.append(i)
                        record.append("\n".join(waiting))
                        waiting = []
            arrays = [pa.array(x, pa.int64()) for x in (file, block, at)] + [pa.array(record, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "block", "id", "record"])

    return run


def read_records(spark: SparkSession, path: str, lexer: Lexer) -> DataFrame:
    """(file, block, id, first, record): every record of the files, without the line end behind it.

    ``first`` marks the first record of a file; file, block and id give the order. The last record
    need not be ended. Blank lines are records or parts of them. Empty files have no records.
    """
    lines = _lines(spark, path)
    splits = lines.mapInArrow(_summaries(lexer), _SUMMARY)
    found = splits.groupBy("file").applyInArrow(_scanned, "file long, block long, first long, last long, record long")
    target = shared_dir(spark, "splits")
    found.write.parquet(target)
    found = spark.read.parquet(target)
    small = found.count() <= SPLITS_AT_ONCE
    joined = lines.join(F.broadcast(found) if small else found, ["file", "block"], "left")
    if not small:  # a shuffle loses the order of lines
        joined = joined.sortWithinPartitions("file", "block", "id")
    error = F.raise_error(F.lit("the input was split in another way in a later pass")).cast("boolean")
    head = (F.col("first") < 0) | (F.col("id") <= F.col("first"))
    inside = F.when(F.col("record").isNull(), error).otherwise(~head & (F.col("id") <= F.col("last")))
    whole = joined.filter(inside).select("file", "block", "id", "value").mapInArrow(_cut(lexer), "file long, block long, id long, record string")
    across = joined.filter(~inside).withColumn("record", F.when(head, F.col("record")).otherwise(F.col("record") + 1))
    across = across.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("parts"))
    across = across.select(
        "file",
        F.col("parts")[0]["block"].alias("block"),
        F.col("parts")[0]["id"].alias("id"),
        (F.col("record") == 0).alias("first"),
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"),
    )
    return whole.select("file", "block", "id", F.lit(False).alias("first"), "record").unionByName(across)
