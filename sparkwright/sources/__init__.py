"""Readers, writers and the warehouse."""

from sparkwright.sources.readers import (
    columns_like,
    csv_inferred,
    csv_text,
    fingerprint,
    inline_values,
    jdbc_query,
    name_sorted,
    numbered_lines,
    parquet,
    row_range,
    schema_of,
)
from sparkwright.sources.scratch import shared_folder, written
from sparkwright.sources.sinks import copy_jdbc, dashboard, html_report, write_csv, write_json, write_parquet
from sparkwright.sources.store import Warehouse

__all__ = [
    "Warehouse", "columns_like", "copy_jdbc", "dashboard", "shared_folder", "written", "csv_inferred", "csv_text", "fingerprint", "html_report", "inline_values", "jdbc_query", "name_sorted", "numbered_lines", "parquet",
    "row_range", "schema_of", "write_csv", "write_json", "write_parquet",
]
