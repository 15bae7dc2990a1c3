"""Readers and writers."""

from incognita.sources.csv_files import detect_delimiter, pseudonymize_csv, read_csv_sniffed, sniff_csv, write_csv
from incognita.sources.databases import (
    Database,
    PageIndex,
    count_rows,
    fetch_after,
    fetch_batch,
    fetch_page,
    list_tables_jdbc,
    read_table_jdbc,
    write_page_index,
    write_table,
    write_table_jdbc,
    write_table_resumed,
)
from incognita.sources.dump import (
    dump_rows,
    dump_schema,
    dump_table,
    export_table,
    insert_tuples,
    parse_inserts,
    pseudonymize_insert_dump,
    read_insert_dump,
    to_insert_statements,
    write_insert_dump,
)
from incognita.sources.json_files import read_json, write_json
from incognita.sources.records import read_records
from incognita.sources.text_files import read_text, write_text

__all__ = [
    "Database",
    "PageIndex",
    "count_rows",
    "detect_delimiter",
    "dump_rows",
    "dump_schema",
    "dump_table",
    "export_table",
    "fetch_after",
    "fetch_batch",
    "fetch_page",
    "insert_tuples",
    "list_tables_jdbc",
    "parse_inserts",
    "pseudonymize_csv",
    "pseudonymize_insert_dump",
    "read_csv_sniffed",
    "read_insert_dump",
    "read_json",
    "read_records",
    "read_table_jdbc",
    "read_text",
    "sniff_csv",
    "to_insert_statements",
    "write_csv",
    "write_insert_dump",
    "write_json",
    "write_page_index",
    "write_table",
    "write_table_jdbc",
    "write_table_resumed",
    "write_text",
]
