import zlib

import data
from pyspark.sql import functions as F

from incognita.llm import op1_sharding as op


def test_curve_visits_every_cell_and_steps_to_a_neighbour(spark):
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = [F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias(f"c{i}") for i in range(dims)]
        grid = spark.range(1 << (bits * dims)).select(*cells)
        out = grid.withColumn("at", op.hilbert_index([F.col(f"c{i}") for i in range(dims)], bits)).orderBy("at").collect()
        assert [r["at"] for r in out] == list(range(1 << (bits * dims)))
        steps = [sum(abs(a[i] - b[i]) for i in range(dims)) for a, b in zip(out, out[1:])]
        assert set(steps) == {1}


def check(out, documents):
    assert len(out) == len(documents)
    want = sorted(((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in documents), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == want
    by = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(documents)
    # the cells are sorted along the curve over shards and slots
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve_index"] for r in order] == sorted(r["curve_index"] for r in out)


def test_query_on_odd_rows(spark):
    check(op.op1_sharding(spark, data.folder(spark)).collect(), data.rows())


def test_query_on_many_equal_rows(spark):
    rows = [(i % 50, "x" * (i % 5), "en", "hot" if i % 3 else f"s{i}", i) for i in range(1003)]
    check(op.op1_sharding(spark, data.folder(spark, rows)).collect(), rows)


def test_empty_table(spark):
    assert op.op1_sharding(spark, data.folder(spark, [])).collect() == []


def test_clashing_columns_and_pruning(spark):
    frame = spark.range(1000).selectExpr(
        "id AS doc_id", "id % 10 AS source", "id % 4 AS lang", "id AS n_chars", "1 AS place", "2 AS local_id", "3 AS shard"
    )
    cells = op.document_cells()
    out = op.shard_rows(frame, cells, ["doc_id"], 16).cache()
    assert out.select("place", "local_id").distinct().collect() == [(1, 2)]
    boxes = op.manifest(out, list(cells))
    wanted = op.spread_out(F.lit(3)).alias("x")
    hit = {r.shard for r in op.shards_for(boxes, {"source_cell": wanted}).collect()}
    holds = {r.shard for r in out.filter("source = 3").select("shard").distinct().collect()}
    assert holds <= hit and len(hit) < 16
    out.unpersist()
