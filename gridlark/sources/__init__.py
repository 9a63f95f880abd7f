"""Readers, schemas and import: from files to typed fact tables."""

from gridlark.sources.ingest import ImportFailed, ImportReport, infer_schema, load_facts
from gridlark.sources.readers import CsvOptions, JsonOptions, estimated_rows, read_csv, read_csv_url, read_json, read_jsonl, read_rows
from gridlark.sources.schema import ColumnSpec, NumberSyntax, Schema

__all__ = [
    "ColumnSpec",
    "CsvOptions",
    "ImportFailed",
    "ImportReport",
    "JsonOptions",
    "NumberSyntax",
    "Schema",
    "estimated_rows",
    "infer_schema",
    "load_facts",
    "read_csv",
    "read_csv_url",
    "read_json",
    "read_jsonl",
    "read_rows",
]
