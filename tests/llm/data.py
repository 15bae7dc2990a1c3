"""Small tables with everything that may be odd."""

import os
import tempfile

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

WORDS = "the of and river stone light under morning walks seldom bright copper lantern quiet harbour".split()


def prose(n, seed=0):
    state, out = seed * 7919 + 17, []
    for i in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(WORDS[state >> 16 & 15 if (state >> 16 & 15) < len(WORDS) else 0] + ("." if i % 9 == 8 else ""))
    return " ".join(out)


def rows():
    """NULLs in every column, empty and long texts, copies, repeated rows, non-ASCII characters."""
    texts = [
        prose(120, 1),
        prose(120, 1),
        prose(120, 2) + "\n" + prose(30, 3),
        "",
        None,
        " \n\t ",
        "one",
        "two words",
        "ÄÖÜ ß 日本 😀 ▁x y \x00 end",
        prose(30_000, 4),
        prose(60, 5) + "\n" + prose(60, 5),
    ]
    out = [(i, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, len(t) if t else None) for i, t in enumerate(texts)]
    out += [out[0], (0, prose(70, 8), "de", "src0", 1), (None, prose(50, 9), "en", None, None), (None, None, None, None, None)]
    return out


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCUMENT)


def folder(spark, data=None, labels=(), embeddings=None):
    """A folder of tables as the queries take it."""
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    documents(spark, data).write.parquet(os.path.join(path, "documents.parquet"))
    kinds = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(*x, 0) for x in labels], kinds).write.parquet(os.path.join(path, "labels.parquet"))
    if embeddings is not None:
        spark.createDataFrame(embeddings, "vec_id long, embedding array<float>, label int").write.parquet(
            os.path.join(path, "embeddings.parquet")
        )
    return path


def listed(df):
    return [tuple(r) for r in df.collect()]


