"""What the operators share: written intermediates, batches of texts as bytes, words as numbers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.session import shared_dir

PIECE = 1 << 20  # bytes of text that are held as numbers at once (one longer text stays whole)
BATCH_ROWS = 500  # rows of an Arrow batch: bounds a worker's memory with texts of 100 KB each, too
BATCH_BYTES = "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts can be long, so Arrow batches hold few rows and a bounded number of bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` by way of the shared folder: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or with underscores in front if the frame has such a column."""
    names = {c.lower() for c in df.columns}
    while wish.lower() in names:
        wish = "_" + wish
    return wish


def column(name: str) -> F.Column:
    """A column by its plain name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and where each row starts (NULL: empty)."""
    values = values.cast(pa.large_binary())
    if values.null_count:
        values = values.fill_null(b"")
    _, starts, data = values.buffers()
    at = np.frombuffer(starts, np.int64)[values.offset : values.offset + len(values) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def pieces(values: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (first, behind last, bytes, starts) of about ``limit`` bytes."""
    data, at = text_bytes(values)
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


# --- words -----------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every input bit counts."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0 … P^n and their inverses modulo 2^64; kept up to a few MB."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size = max(n, PIECE) + 1
    base = [0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)]
    out = []
    for p in base:
        x = np.full(size, p, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    if size <= 4 * PIECE:
        _powers[:] = out
    return out[0], out[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any run of bytes."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters()[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs start … end, equal for equal runs wherever they lie."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words [^\\x20\\x09-\\x0D]+ of each row; none crosses rows."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    row = np.searchsorted(at, start, "right") - 1
    return start, end, row
