"""The indexing job: files in, the entity tables out."""

from __future__ import annotations

import uuid
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.plans import python_rules, script_rules
from codelake.plans.lines import (KEY, carrying, file_keys, lines, named, numbered, restored, spread, statements,
                                  text_bytes)
from codelake.schemas import TABLES
from codelake.session import new_folder
from codelake.sources.scan import detect_language, diff_files, file_facts, file_rows, files_with
from codelake.sources.tables import TableStore

ENTITIES = ("symbols", "types", "imports", "exports", "scopes", "references")


class Extraction:
    """The six entity tables of a set of files, each a lazy frame.

    `keep` stores what several tables share (lines, statements, definitions, spans) with the
    executors while the tables are written, in memory or on their disks; release() drops it. Contents
    are so shuffled and masked once a family, and the lines keep their layout and order, which later
    windows use. A lost executor's part is made again from the files. Tokens are many times the lines
    and cheap to make from them, so they are never kept. In all of these, files are numbered, and the rows of the
    tables get the keys of their files at the end: those of scripts by a join, those of Python, which pass fewer windows, carry them. `size` is the bytes of the contents, or more;
    where it is not told, the contents are counted.
    """

    def __init__(self, files: DataFrame, keep: bool = False, size: int | None = None):
        self.files = files if "language" in files.columns else detect_language(files)
        self.keep = keep
        self._size = size
        self._kept: list[DataFrame] = []

    def _hold(self, df: DataFrame) -> DataFrame:
        if self.keep:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._kept.append(df)
        return df

    def release(self) -> None:
        for df in self._kept:
            df.unpersist()

    @cached_property
    def size(self) -> int:
        return text_bytes(self.files) if self._size is None else self._size

    @cached_property
    def python_files(self) -> DataFrame:
        return self.files.where(F.col("language") == "python")

    @cached_property
    def script_files(self) -> DataFrame:
        return self.files.where(F.col("language").isin("javascript", "typescript"))

    @cached_property
    def python_keys(self) -> DataFrame:
        return self._hold(file_keys(self.python_files, self.size))

    @cached_property
    def script_keys(self) -> DataFrame:
        return self._hold(file_keys(self.script_files, self.size))

    def _script_named(self, rows: DataFrame) -> DataFrame:
        return named(rows, self.script_keys)

    @cached_property
    def python_lines(self) -> DataFrame:
        return self._hold(lines(spread(carrying(self.python_files), self.size), "python"))

    @cached_property
    def script_lines(self) -> DataFrame:
        return self._hold(lines(spread(numbered(self.script_files), self.size), "script"))

    @cached_property
    def definitions(self) -> DataFrame:
        return self._hold(python_rules.definitions(self.python_statements))

    @cached_property
    def python_statements(self) -> DataFrame:
        return self._hold(statements(self.python_lines, "python"))

    @cached_property
    def python_marked(self) -> DataFrame:
        return self.python_statements.where("kind is not null")

    @cached_property
    def script_marked(self) -> DataFrame:
        return self._hold(statements(self.script_lines, "script").where("kind is not null"))

    @cached_property
    def script_tokens(self) -> DataFrame:
        return script_rules.neighbours(self.script_lines)

    @cached_property
    def spans(self) -> DataFrame:
        return self._hold(script_rules.spans(self.script_tokens))

    def python(self, entity: str) -> DataFrame:
        if entity == "references":
            return python_rules.references(python_rules.referring_tokens(self.python_lines), restored)
        if entity == "symbols":
            return python_rules.symbols(restored(self.definitions))
        if entity == "scopes":
            return python_rules.scopes(restored(self.definitions), self.python_files)
        return getattr(python_rules, entity)(restored(self.python_marked))

    def script(self, entity: str) -> DataFrame:
        if entity == "references":
            return script_rules.references(self.script_tokens, self._script_named)
        if entity == "symbols":
            return script_rules.symbols(self.spans, self._script_named)
        if entity == "scopes":
            return script_rules.scopes(self.spans, self.script_files, self._script_named)
        if entity == "imports":
            return script_rules.imports(*map(self._script_named, (self.script_marked, self.script_lines)))
        return getattr(script_rules, entity)(self._script_named(self.script_marked))

    def table(self, entity: str) -> DataFrame:
        schema = TABLES[entity].schema
        return reduce(DataFrame.unionByName, [
            part.select(*[F.col(f.name).cast(f.dataType) for f in schema])
            for part in (self.python(entity), self.script(entity))])

    def tables(self) -> dict[str, DataFrame]:
        return {e: self.table(e) for e in ENTITIES}

    def stored(self, *entities: str) -> dict[str, DataFrame]:
        """Some of the tables, extracted once into the shared folder and read from there, for callers that use a
        table several times."""
        spark = self.files.sparkSession
        folder = new_folder(spark, "entities")
        for entity in entities:
            self.table(entity).write.parquet(f"{folder}/{entity}")
        self.release()
        return {e: spark.read.schema(TABLES[e].schema).parquet(f"{folder}/{e}") for e in entities}


def write_entities(store: TableStore, files: DataFrame, replaced: DataFrame, size: int | None = None) -> None:
    """Extract the entities of some files into the stored tables. The old rows of the replaced files go;
    only the buckets of these files are rewritten. `size` is as for Extraction."""
    work = Extraction(files, keep=True, size=size)
    for entity in ENTITIES:
        store.bucketed(entity).replace_files(work.table(entity), replaced)
    work.release()


def index_project(store: TableStore, scan: DataFrame, force: bool = False,
                  indexed_at=None) -> DataFrame:
    """Index what is new or changed in a scan into the stored tables; returns the file status.

    Only files whose hash moved are read again. Their old rows, and those of files that are gone
    from the projects of the scan, leave every table in the same rewrite that brings the new ones, which
    touches the buckets of these files alone; an unchanged run writes nothing. A file that could not be read
    keeps its old rows and gets a row with its error in the files table.
    """
    when = F.current_timestamp() if indexed_at is None else indexed_at
    facts = file_facts(detect_language(scan))
    files = store.bucketed("files")
    # Written out, because the status must not move once the files table does.
    path = f"{store.root}/.runs/{uuid.uuid4().hex}"
    diff_files(facts, files.read(), force).write.parquet(path)
    diff = store.spark.read.parquet(path)
    todo, gone, failed = (files_with(diff, *s) for s in (("new", "changed"), ("file_not_found",), ("failed",)))
    replaced = todo.unionByName(gone)
    if not replaced.isEmpty():
        chosen = scan.join(todo, KEY, "left_semi")
        # counted before the join, which would move the contents; files that stay make it no smaller
        write_entities(store, chosen, replaced, text_bytes(scan))
        # The files table comes last: a run that breaks off is found as still to do.
        if not todo.isEmpty():
            files.append(file_rows(chosen, when))
        files.replace_files(files.read().where("false"), gone)
    if not failed.isEmpty():
        files.append(file_rows(scan.join(failed, KEY, "left_semi"), when))
    return diff
