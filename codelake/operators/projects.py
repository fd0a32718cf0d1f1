"""Projects: creation, updates, lookup by name, and deletion from every stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.operators.versions import latest_by_key
from codelake.sources.tables import TableStore


class ProjectMissing(ValueError):
    pass


def newest_projects(projects: DataFrame, name: str | None = None) -> DataFrame:
    """The newest row of each project name, or of one."""
    if name is not None:
        projects = projects.where(F.col("project_name") == name)
    return latest_by_key(projects, ["project_name"], "updated_at", ["project_id"])


def project_id_of(projects: DataFrame, name: str) -> str:
    row = newest_projects(projects, name).select("project_id").first()
    if row is None:
        raise ProjectMissing(f"no project is named {name}")
    return row.project_id


def create_project(projects: DataFrame, project_id: str, name: str, root_path: str, now: Column,
                   **more: str) -> DataFrame:
    """The row of a new project, to be appended; fields that are not given are NULL."""
    given = {"project_id": project_id, "project_name": name, "root_path": root_path, **more}
    values = {c: F.lit(v) for c, v in given.items()} | {"created_at": now, "updated_at": now}
    one = projects.sparkSession.range(1)
    return one.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in projects.schema])


def update_project(projects: DataFrame, name: str, now: Column, **fields: str) -> DataFrame:
    """The next version of a project with some fields changed, to be appended."""
    values = {c: F.lit(v) for c, v in fields.items()} | {"updated_at": now}
    return newest_projects(projects, name).select(
        *[values[f.name].cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name)
          for f in projects.schema])


def of_project(rows: DataFrame, projects: DataFrame, name: str) -> DataFrame:
    """The rows of a project given by name; none for an unknown name."""
    wanted = newest_projects(projects, name).select(F.col("project_id").alias("_wanted"))
    return rows.join(wanted, F.col("project_id") == F.col("_wanted"), "left_semi")


def delete_project(store: TableStore, project_id: str) -> dict[str, int]:
    """Delete a project's rows from every stored table that has any; the rows removed of each."""
    return _delete(store, {"project_id": project_id})


def delete_file(store: TableStore, project_id: str, file_path: str) -> dict[str, int]:
    """Delete one file's rows from every stored table that knows files."""
    return _delete(store, {"project_id": project_id, "file_path": file_path})


def _delete(store: TableStore, equals: dict[str, str]) -> dict[str, int]:
    names = [n for n in store.views() if set(equals) <= set(store.read(n).columns)]
    return {name: store.delete_where(name, equals) for name in names}
