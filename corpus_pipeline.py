"""The corpus pipeline: documents in, encoded training documents out.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read
again as the next one's input. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.llm.common import column, free_name, table, written
from incognita.llm.op2_mixing import drawn, fit_domains, fit_rates, language_labels, memberships, with_rates
from incognita.llm.op4_neardup import near_duplicates
from incognita.llm.op5_quality import CUTOFF, quality_model, score
from incognita.llm.op6_secrets import fit_model as fit_secrets
from incognita.llm.op6_secrets import scan
from incognita.llm.op7_pieces import encode, load_pieces, model_path

WORDS, PERCENT = 5, 80  # near duplicates here: shingles of five words, similarity 0.8 or more
TARGETS = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}


def protected(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its own columns of these names (in any case) put aside; new names to old."""
    back = {}
    for c in docs.columns:
        if c.lower() in names:
            back[free_name(docs, f"aside_{c}")] = c
    return docs.withColumnsRenamed({old: new for new, old in back.items()}), back


def restored(df: DataFrame, back: dict[str, str], names: list[str]) -> DataFrame:
    """The columns ``names`` again, those that were put aside under their own names."""
    return df.select(*[column({old: new for new, old in back.items()}.get(c, c)).alias(c) for c in names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged.

    Labels of documents that are no longer there take no part. Blank texts score 0 and go. With
    labels of one kind only the score is constant; without any, all documents stay.
    """
    model = quality_model(spark, sf_dir, docs)
    if not model.fitted:
        return docs
    name = free_name(docs, "quality_score")
    return score(docs, model, name=name).filter(column(name) >= CUTOFF).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id.

    Linked are texts that share 80 % of their five-word shingles, also by way of others. Of rows that repeat this doc_id, the row that is least by text, then by the other columns,
    stays (NULL first). Rows without a doc_id stay; so do blank texts, which are no duplicates of
    each other.
    """
    n = free_name(docs, "rows_of_id")
    kept = near_duplicates(docs, WORDS, PERCENT).filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias(n))
    kept = written(kept, "kept")
    bare = docs.filter("doc_id IS NULL")
    once = docs.join(kept.filter(column(n) == 1), "doc_id", "left_semi")
    out = once.unionByName(bare)
    if kept.filter(column(n) > 1).take(1):
        rest = [c for c in docs.columns if c != "doc_id"]
        row = F.struct(*[column(c) for c in ("text", *[c for c in rest if c != "text"])])
        many = docs.join(kept.filter(column(n) > 1), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias(n))
        many = many.select("doc_id", *[column(n).getField(c).alias(c) for c in rest])
        out = out.unionByName(many)
    return out.select(*[column(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret found is replaced by its kind in brackets, n_chars follows."""
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    apart, back = protected(docs, names)
    clean = scan(apart, fit_secrets(docs.select("doc_id", "text")), redact=True).drop(*names)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return restored(clean, back, docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at rates by which languages reach their shares; none has a rate below 1,
    so every document is there at least once. Without labelled documents all stay as they are."""
    labels = language_labels(spark, sf_dir, docs, low=False)
    model = fit_domains(docs, labels, list(TARGETS))
    if not model.fitted:
        return docs
    members = written(memberships(docs.select("doc_id", "text"), model).drop("text"), "members")
    rates = fit_rates(members, list(TARGETS.values()), least=1.0)
    apart, back = protected(docs, ["tokens", "posteriors", "rate"])
    rated = with_rates(memberships(apart, model), rates)
    return restored(drawn(rated), back, docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces, lossless) of every document row."""
    out = encode(docs.select("doc_id", "text"), load_pieces(model_path()))
    return out.select(
        "doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", F.col("pieces_lossless").alias("lossless")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs


ORACLE_SQL = None  # a trained classifier and seeded hashes are beyond SQL
