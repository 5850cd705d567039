"""Schemas of the index tables. Positions are 0-based; range ends are inclusive; null and false differ."""

from __future__ import annotations

from pyspark.sql import types as T

RANGE = "start_line int, start_character int, end_line int, end_character int"
SYMBOLS = (
    "uri string, ordinal int, id string, name string, kind string, line int, character int, " + RANGE + ", container_name string, container_kind string, full_container_path string, "
    "is_static boolean, is_definition boolean, is_exported boolean, parameters_count int, visibility string, implements array<string>, extends string, "
    "ngrx struct<type string, role string, is_group boolean, events map<string, string>>, metadata string, is_public boolean"
)
REFS = "uri string, symbol_name string, line int, character int, " + RANGE + ", container_name string, is_import boolean, scope_id string, is_local boolean"
PENDING = "uri string, container string, member string, line int, character int, container_name string"
IMPORTS = "uri string, ordinal int, local_name string, module_specifier string, is_default boolean, is_namespace boolean, exported_name string, is_dynamic boolean, is_cjs boolean"
REEXPORTS = "uri string, ordinal int, module_specifier string, is_all boolean, exported_names array<string>"
FILES = "uri string, hash string, mtime double, size long, last_indexed_at long, skip_reason string, n_symbols int"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
