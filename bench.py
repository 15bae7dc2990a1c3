"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from incognita.plans.queries import REGISTRY
from incognita.session import SETTINGS

HEADLINE = [
    "findings_by_type",
    "find_all",
    "find_all_enriched",
    "find_all_pages",
    "distinct_findings",
    "detect_value",
    "detect_columns",
    "doc_pattern_findings",
    "pseudonymize_text",
    "pseudonymize_text_enriched",
    "redact_document",
    "pseudonymize_table",
    "pseudonymize_lineitem",
    "pseudonymize_json",
    "pseudonymize_insert_dump",
    "pseudonymize_csv",
    "pseudonymize_stream",
    "read_insert_dump",
    "scan_cells",
    "json_keys",
    "build_mapping",
    "build_mapping_unique",
    "apply_mapping",
    "mapping_stats_lineitem",
    "mark_preserved",
    "run_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start-up is not measured
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
