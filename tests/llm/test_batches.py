"""Several Arrow batches of unlike content in one task: results do not depend on where batches end."""

import data
import pytest

from incognita.llm import (
    op3_pseudonyms, op4_neardup, op5_quality, op6_secrets, op7_pieces, op9_rules, op10_substrings, op11_importance, op12_html,
)


def many():
    """1,200 rows: runs of NULL, of empty texts, of copies, of values and secrets, of prose; one long text."""
    kinds = [
        lambda i: None,
        lambda i: "",
        lambda i: data.prose(60, 1),
        lambda i: f"token=abcdefgh{i:08d} mail{i}@ex.org 4111 1111 1111 1111 morninglightcopperharbour",
        lambda i: data.prose(20 + i % 50, i),
        lambda i: "Ä 日本 \x00 " * (i % 9),
    ]
    rows = [(i, kinds[i // 200](i), "en", f"s{i % 3}", None) for i in range(1200)]
    rows[900] = (900, data.prose(20_000, 9), "en", "s0", None)
    return rows


@pytest.fixture(scope="module")
def path(spark):
    found = data.folder(spark, [], labels=[(i, i % 2) for i in range(0, 1200, 3)])
    data.documents(spark, many()).coalesce(1).write.mode("overwrite").parquet(f"{found}/documents.parquet")
    pages = spark.createDataFrame([(r[0], "u", None if r[1] is None else f"<article><p>{r[1]}</p></article>") for r in many()], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{found}/pages.parquet")
    spark.createDataFrame([(i, data.prose(30, i)) for i in range(20)], "item_id long, text string").write.parquet(f"{found}/benchmark.parquet")
    return found


QUERIES = [
    op3_pseudonyms.op3_pseudonyms, op4_neardup.op4_neardup, op5_quality.op5_quality, op6_secrets.op6_secrets, op7_pieces.op7_pieces,
    op9_rules.op9_rules, op10_substrings.op10_substrings, op11_importance.op11_importance, op12_html.op12_html,
]


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_results_do_not_depend_on_batches(spark, path, query):
    found = []
    for size in ("10000", "37"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        # sums of doubles may differ in their last places
        rows = [[round(x, 9) if isinstance(x, float) else x for x in r] for r in query(spark, path).collect()]
        found.append(sorted(map(str, rows)))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found[0]) == 1200 and found[0] == found[1]
