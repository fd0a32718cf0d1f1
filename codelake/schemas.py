"""Table schemas, sort keys and version columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    """`name type` pairs; a trailing ? marks optional columns, all are nullable on disk."""
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name.rstrip("?"), _TYPES[kind], True))
    return T.StructType(fields)


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "short": T.ShortType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "time": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
}


@dataclass(frozen=True)
class TableSpec:
    schema: T.StructType
    sort_by: tuple[str, ...]
    keys: tuple[str, ...] = ()
    version: str | None = None


TABLES: dict[str, TableSpec] = {
    "projects": TableSpec(
        _struct("project_id string, project_name string, root_path string, description? string,"
                "version? string, git_remote? string, git_branch? string, git_commit? string,"
                "created_at time, updated_at time, metadata? string"),
        ("project_name",), ("project_name",), "updated_at"),
    "documents": TableSpec(
        _struct("document_id string, project_id string, file_path string, doc_type string,"
                "title? string, content string, content_hash string, format string,"
                "word_count int, indexed_at time, metadata? string"),
        ("project_id", "file_path"), ("project_id", "file_path"), "indexed_at"),
    "files": TableSpec(
        _struct("file_id string, project_id string, file_path string, language string,"
                "content_hash string, line_count int, byte_size long, indexed_at time,"
                "parse_duration_ms? double, error_message? string"),
        ("project_id", "file_path"), ("project_id", "file_path"), "indexed_at"),
    "symbols": TableSpec(
        _struct("symbol_id string, project_id string, file_path string, name string,"
                "qualified_name string, kind string, visibility string, start_line int,"
                "end_line int, start_col int, end_col int, parent_symbol_id? string,"
                "scope_id? string, docstring? string, signature? string, is_async bool,"
                "is_static bool, decorators strings, metadata? string"),
        ("project_id", "file_path", "start_line", "name")),
    "types": TableSpec(
        _struct("type_id string, project_id string, file_path string, symbol_id? string,"
                "name string, kind string, type_expression string, start_line int, end_line int,"
                "is_generic bool, generic_params strings, metadata? string"),
        ("project_id", "file_path", "start_line")),
    "imports": TableSpec(
        _struct("import_id string, project_id string, file_path string, module_path string,"
                "imported_names strings, alias? string, is_relative bool, relative_level int,"
                "import_kind string, start_line int, is_type_only bool"),
        ("project_id", "file_path", "start_line")),
    "exports": TableSpec(
        _struct("export_id string, project_id string, file_path string, symbol_id? string,"
                "exported_name string, original_name? string, export_kind string, start_line int"),
        ("project_id", "file_path", "exported_name")),
    "scopes": TableSpec(
        _struct("scope_id string, project_id string, file_path string, parent_scope_id? string,"
                "kind string, name? string, start_line int, end_line int, depth int"),
        ("project_id", "file_path", "start_line")),
    "references": TableSpec(
        _struct("reference_id string, project_id string, file_path string, symbol_id? string,"
                "name string, kind string, start_line int, start_col int, scope_id? string,"
                "is_definition bool"),
        ("project_id", "file_path", "start_line", "start_col")),
    "edges": TableSpec(
        _struct("edge_id string, source_file string, source_line int, source_col int,"
                "source_symbol_id? string, target_file string, target_line int, target_col int,"
                "target_symbol_id? string, edge_type string, resolved_by string,"
                "lsp_server? string, resolved_at time"),
        ("edge_type", "source_file", "source_line", "source_col"),
        ("edge_type", "source_file", "source_line", "source_col"), "resolved_at"),
    "sessions": TableSpec(
        _struct("session_id string, project_id string, title string, description? string,"
                "model? string, provider? string, message_count long, token_count long,"
                "created_at time, updated_at time, archived_at? time, metadata? string"),
        ("project_id", "session_id"), ("project_id", "session_id"), "updated_at"),
    "session_messages": TableSpec(
        _struct("message_id string, session_id string, project_id string, role string,"
                "content string, token_count int, created_at time, sequence_number int,"
                "metadata? string"),
        ("session_id", "sequence_number")),
    "todos": TableSpec(
        _struct("todo_id string, project_id string, title string, description? string,"
                "status string, priority string, file_path? string, line_number? int,"
                "assigned_to? string, created_at time, updated_at time, completed_at? time,"
                "due_date? time, tags strings, metadata? string"),
        ("project_id", "status", "priority", "created_at"), ("todo_id",), "updated_at"),
    "metadata": TableSpec(
        _struct("key string, value? string, created_at time, updated_at time"),
        ("key",), ("key",), "updated_at"),
}
