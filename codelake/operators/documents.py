"""Documentation files: selection, typed index, listing, search and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions.paths import (DOCUMENT_PATTERNS, document_format, document_title,
                                      document_type, matches_any)
from codelake.functions.text import occurrences, row_id, word_count
from codelake.operators.versions import latest_by_key
from codelake.session import new_folder
from codelake.sources.tables import TableStore

KEY = ["project_id", "file_path"]


def select_documents(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Documentation files by path; a path that fits several patterns counts once.

    Needs one row per path, which a scan gives; database files and folders are left out, by whole
    names in the path.
    """
    inside = F.col("file_path").rlike(r"(^|/)store/|\.db(/|$)")
    return files.where(matches_any("file_path", patterns or DOCUMENT_PATTERNS) & ~inside)


def index_documents(files: DataFrame, indexed_at=None) -> DataFrame:
    """Rows of the documents table."""
    when = F.current_timestamp() if indexed_at is None else indexed_at
    return files.select(
        row_id(*KEY).alias("document_id"), *KEY, document_type("file_path").alias("doc_type"),
        document_title(F.col("content"), "file_path").alias("title"), "content",
        F.sha2("content", 256).alias("content_hash"),
        document_format("file_path").alias("format"),
        word_count("content").cast("int").alias("word_count"),
        when.alias("indexed_at"), F.lit("{}").alias("metadata"))


def store_documents(store: TableStore, files: DataFrame, indexed_at=None) -> DataFrame:
    """Keep the stored documents table current with a scan; (metric, value) of the run.

    A document whose stored hash is the same is skipped; a new or changed one is indexed and replaces its old row,
    in the folders of changed files only; one without content (it could not be read) is counted as failed and
    keeps its old row. Documents that the scan does not hold stay. Running it again skips everything."""
    table, chosen = store.bucketed("documents"), select_documents(files)
    known = table.read().select(*KEY, F.col("content_hash").alias("_old"))
    new_hash = F.sha2("content", 256)
    status = (F.when(F.col("content").isNull(), "failed").when(F.col("_old").eqNullSafe(new_hash), "skipped")
              .otherwise("indexed"))
    # Written out, because the status must not move once the table does.
    path = new_folder(store.spark, "document-status")
    (chosen.join(known, KEY, "left").select(*KEY, status.alias("status"), word_count("content").alias("words"))
     .write.parquet(path))
    run = store.spark.read.parquet(path)
    todo = run.where("status = 'indexed'").select(*KEY)
    table.replace_files(index_documents(chosen.join(todo, KEY, "left_semi"), indexed_at), todo)
    counts = run.agg(*[F.count_if(F.col("status") == s).alias(f"files_{s}") for s in ("indexed", "skipped", "failed")],
                     F.coalesce(F.sum(F.when(F.col("status") == "indexed", F.col("words"))), F.lit(0))
                     .cast("bigint").alias("total_words"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"))
                                             for c in counts.columns])).alias("m")).select("m.*")


def document_totals(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count(F.lit(1)).alias("files_indexed"),
                         F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"))


def list_documents(documents: DataFrame, project: str, doc_type: str | None = None) -> DataFrame:
    """Newest version of each document of a project, without its content."""
    columns = [c for c in documents.columns if c != "content"]
    newest = latest_by_key(documents.where(F.col("project_id") == project).select(*columns),
                           KEY, "indexed_at", ["content_hash"])
    if doc_type:
        newest = newest.where(F.col("doc_type") == doc_type)
    return newest.orderBy("file_path")


def get_documents(documents: DataFrame, project: str, paths: DataFrame) -> DataFrame:
    """Full rows for a frame of paths, newest version.

    The semi join comes first, so only the wanted contents are ever shuffled.
    """
    wanted = documents.where(F.col("project_id") == project).join(
        paths.select("file_path"), "file_path", "left_semi")
    return latest_by_key(wanted, KEY, "indexed_at", ["content_hash"])


def search_documents(documents: DataFrame, project: str, query: str,
                     limit: int | None = None) -> DataFrame:
    """Documents that contain the text, case-insensitively, best first.

    Newest versions are picked on hashes alone; contents are reduced to a count before any
    shuffle.
    """
    text = F.lower("content")
    scored = documents.where(F.col("project_id") == project).select(
        *KEY, "title", "word_count", "indexed_at", "content_hash",
        occurrences(text, query.lower()).alias("hits"))
    newest = latest_by_key(scored, KEY, "indexed_at", ["content_hash"]).where("hits > 0")
    ranked = newest.select("file_path", "title", "word_count", "hits").orderBy(
        F.desc("hits"), "file_path")
    return ranked if limit is None else ranked.limit(limit)


def document_breakdown(documents: DataFrame) -> DataFrame:
    return documents.groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("word_count").cast("bigint").alias("words"))


def concept_coverage(documents: DataFrame, terms: list[str]) -> DataFrame:
    """How many documents mention each term, in one pass without a join."""
    text = F.lower("content")
    sums = [F.count_if(text.contains(t.lower())).alias(f"t{i}") for i, t in enumerate(terms)]
    pairs = [F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("documents"))
             for i, t in enumerate(terms)]
    return documents.agg(*sums).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
