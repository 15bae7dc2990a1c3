"""Operators: DataFrame in, DataFrame out."""

from incognita.operators.catalog import (
    analyze_schema,
    available_types,
    detect_columns,
    list_tables,
    primary_keys,
    row_counts,
    suggest_rules,
    table_columns,
)
from incognita.operators.json_docs import (
    detect_json_keys,
    json_keys,
    preview_rows,
    pseudonymize_json,
    pseudonymize_json_text,
)
from incognita.operators.layout import spread
from incognita.operators.mapping import apply_mapping, build_mapping, make_unique, mapping_stats, originals
from incognita.operators.preserve import mark_preserved
from incognita.operators.retention import drop_expired
from incognita.operators.sheets import profile_sheets, pseudonymize_sheets, scan_cells, scan_sheets
from incognita.operators.tables import (
    StreamProgress,
    pseudonymize_table,
    pseudonymize_tables,
    rules_from_frame,
    run_summary,
    table_summary,
    with_progress,
)
from incognita.operators.texts import (
    distinct_findings,
    document_findings,
    document_profile,
    findings,
    text_sample,
)

__all__ = [
    "StreamProgress",
    "analyze_schema",
    "apply_mapping",
    "available_types",
    "build_mapping",
    "detect_columns",
    "detect_json_keys",
    "distinct_findings",
    "document_findings",
    "document_profile",
    "drop_expired",
    "findings",
    "json_keys",
    "list_tables",
    "make_unique",
    "mapping_stats",
    "mark_preserved",
    "originals",
    "preview_rows",
    "primary_keys",
    "profile_sheets",
    "pseudonymize_json",
    "pseudonymize_json_text",
    "pseudonymize_sheets",
    "pseudonymize_table",
    "pseudonymize_tables",
    "row_counts",
    "rules_from_frame",
    "run_summary",
    "scan_cells",
    "scan_sheets",
    "spread",
    "suggest_rules",
    "table_columns",
    "table_summary",
    "text_sample",
    "with_progress",
]
