"""Todo rows: upsert with defaults, filtered listing, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.operators.versions import apply_changes
from codelake.sources.tables import rows_without

# What a new todo starts with.
DEFAULTS = {"status": "open", "priority": "medium"}


def upsert_todos(todos: DataFrame, changes: DataFrame, project: str | None = None,
                 now: Column | None = None, version: str | None = None) -> DataFrame:
    """Insert or update todos. Of several changes for one todo the newest `version` counts.

    New todos get the given project and, with `now`, their times; an update moves updated_at."""
    defaults = {k: F.lit(v) for k, v in DEFAULTS.items()}
    if project is not None:
        defaults["project_id"] = F.lit(project)
    if now is not None:
        changes = changes.withColumn("updated_at", now)
        defaults |= {"created_at": now, "updated_at": now}
    return apply_changes(todos, changes, ["todo_id"], version=version, defaults=defaults)


def list_todos(todos: DataFrame, project: str | None = None, status: str | None = None,
               priority: str | None = None, assigned_to: str | None = None,
               file_path: str | None = None, tag: str | None = None,
               todo_id: str | None = None) -> DataFrame:
    """Todos that fit every given filter, in table order."""
    equals = {"project_id": project, "status": status, "priority": priority,
              "assigned_to": assigned_to, "file_path": file_path, "todo_id": todo_id}
    for column, value in equals.items():
        if value is not None:
            todos = todos.where(F.col(column) == value)
    if tag is not None:
        todos = todos.where(F.array_contains("tags", tag))
    return todos.orderBy("project_id", "status", "priority", "created_at", "todo_id")


def delete_todos(todos: DataFrame, equals: dict) -> DataFrame:
    return rows_without(todos, equals)
