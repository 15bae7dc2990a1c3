"""Pages by directory, resumed writes, progress of streams, layout of inputs."""

import pytest
from pyspark.sql import functions as F

from incognita import operators as op
from incognita import sources as src
from incognita import streaming
from incognita.functions import pseudonymize_text
from incognita.plans.queries import REGISTRY


def test_pages_equal_sorted_batches(spark, tmp_path):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    index = src.write_page_index(df, "k", str(tmp_path / "p"), parts=7)
    for page in (0, 3, 9, 10):
        got = [tuple(r) for r in src.fetch_page(index, ["k", "v"], page, 100).collect()]
        assert got == [tuple(r) for r in src.fetch_batch(df, ["k", "v"], "k", page * 100, 100).collect()]
    plan = src.fetch_page(index, ["k"], 2, 50)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [__part" in plan
    touched = src.fetch_page(index, ["k"], 2, 50).select(F.input_file_name().alias("f")).distinct().count()
    assert touched <= 2
    empty = src.write_page_index(df.limit(0), "k", str(tmp_path / "none"))
    assert src.fetch_page(empty, ["k"], 0, 10).collect() == []


def test_a_stopped_run_goes_on(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(300).select("id", F.when(F.col("id") % 6 > 0, F.concat(F.lit("g "), (F.col("id") % 6).cast("string"))).alias("g"))
    bomb = df.withColumn("id", F.when(F.col("g") == "g 4", F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stop"):
        src.write_table_resumed(bomb, path, "g", 1)
    assert src.write_table_resumed(df, path, "g", 1) == 3
    assert src.write_table_resumed(df, path, "g", 1) == 0
    back = spark.read.parquet(path).select("id", "g")
    assert back.count() == 300 and back.exceptAll(df).count() == 0


def test_progress_over_micro_batches_and_a_restart(spark, tmp_path):
    schema = "id long, email string"
    make = spark.range(90).selectExpr("id", "IF(id % 3 = 0, NULL, concat('a', id, '@b.de')) AS email")
    make.repartition(6).write.parquet(str(tmp_path / "in"))
    rules = {"email": "email"}

    def start():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        counted, _ = op.with_progress(stream, "t", rules)
        return streaming.start_available(streaming.pseudonymize_stream(counted, rules), str(tmp_path / "out"), str(tmp_path / "check"))

    progress, calls = op.StreamProgress(), []
    assert progress.follow(start(), lambda t: calls.append(dict(t)), 0.2) == {"t": {"processed": 90, "updated": 60}}
    assert calls[-1] == progress.tables
    make.write.mode("append").parquet(str(tmp_path / "in"))
    progress.follow(start())
    assert progress.tables == {"t": {"processed": 180, "updated": 120}}


def test_only_small_inputs_are_dealt_anew(spark, tmp_path):
    path = str(tmp_path / "few")
    spark.range(100_000).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert op.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert op.spread(df, limit=1000).rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_a_rule_frame_of_any_size_is_an_error(spark, monkeypatch):
    rules = spark.range(20).selectExpr("'t' AS table", "concat('c', id) AS column", "'city' AS type", "'keep' AS action")
    assert len(op.rules_from_frame(rules)["t"]) == 20
    monkeypatch.setattr("incognita.operators.tables.RULES_AT_MOST", 10)
    with pytest.raises(ValueError, match="more than 10 rules"):
        op.rules_from_frame(rules)


def test_text_stream_over_a_file_or_a_folder(spark, tmp_path):
    """The documents may be one file or a folder of part files; both are worked off whole."""
    rows = [(i, f"mail an a{i}@b.de") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "parts").glob("part-*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    want = {r["doc_id"]: r["t"] for r in docs.select("doc_id", pseudonymize_text(F.col("text")).alias("t")).collect()}
    for kind in ("folder", "file"):
        out = REGISTRY["pseudonymize_text_stream"](spark, str(tmp_path / kind)).collect()
        assert {r["doc_id"]: r["text"] for r in out} == want
        assert len(out) == 6
