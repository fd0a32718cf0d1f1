"""Finding source files and telling what changed since the last run."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.functions.paths import LANGUAGES, language_of, matches_any
from codelake.functions.text import row_id
from codelake.operators.versions import latest_by_key

FILE_KEY = ["project_id", "file_path"]


def scan_files(spark: SparkSession, root: str, recursive: bool = True,
               patterns: list[str] | None = None, extensions: list[str] | None = None,
               listing: DataFrame | None = None, max_bytes: int = 64 << 20) -> DataFrame:
    """(file_path, content, content_hash, byte_size, modified, error_message) of the files of a folder.

    The hash is that of the bytes; bytes that are no UTF-8 become replacement characters. A file
    above max_bytes is listed without content and with an error, so one large file ends no job.
    Spark's reader leaves out files of zero bytes and names that start with an underscore, such as
    __init__.py: they come from `listing` (file_path, byte_size), which skipped_files makes for a
    folder, and are opened one by one in the tasks. One that can't be read gets its error.
    """
    wanted = list(LANGUAGES) if extensions is None else extensions

    def chosen(files: DataFrame, path: str) -> DataFrame:
        if wanted:
            ends = [F.lower(path).endswith(e) for e in wanted]
            files = files.where(reduce(lambda a, b: a | b, ends))
        return files.where(matches_any(path, patterns)) if patterns else files

    files = chosen(spark.read.format("binaryFile")
                   .option("recursiveFileLookup", str(recursive).lower()).load(root), "path")
    small = files.where(F.col("length") <= max_bytes).select(
        F.col("path").alias("file_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.sha2("content", 256).alias("content_hash"), F.col("length").alias("byte_size"),
        F.col("modificationTime").alias("modified"), F.lit(None).cast("string").alias("error_message"))
    none = F.lit(None).cast("string")
    large = files.where(F.col("length") > max_bytes).select(
        F.col("path").alias("file_path"), none.alias("content"), none.alias("content_hash"),
        F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified"),
        F.concat(F.lit("file too large: "), F.col("length").cast("string")).alias("error_message"))
    out = small.unionByName(large)
    if listing is not None:
        rows = chosen(listing, "file_path").select("file_path", F.col("byte_size").cast("bigint"))
        read = rows.mapInArrow(_opener(max_bytes), "file_path string, byte_size bigint, bytes binary, error_message string")
        out = out.unionByName(read.select(
            "file_path", F.make_valid_utf8(F.col("bytes").cast("string")).alias("content"),
            F.sha2("bytes", 256).alias("content_hash"), "byte_size",
            F.lit(None).cast("timestamp").alias("modified"), "error_message"))
    return out


def _opener(max_bytes: int):
    def read(path: str, size: int) -> tuple[bytes | None, str | None]:
        if size > max_bytes:
            return None, f"file too large: {size}"
        try:
            if not size:
                return b"", None
            fs, name = pa.fs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as file:
                return file.read(), None
        except (OSError, pa.ArrowException) as e:
            return None, str(e)[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                data, error = read(path, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([size]), pa.array([data], pa.binary()), pa.array([error], pa.string())],
                    names=["file_path", "byte_size", "bytes", "error_message"])
    return run


def skipped_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(file_path, byte_size) of the files under a folder that Spark's reader leaves out.

    The listing is walked on the driver, as the reader's own index is; only such files are kept.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, recursive)
    names = []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0 or status.getPath().getName().startswith("_"):
            names.append((status.getPath().toUri().toString(), status.getLen()))
    return spark.createDataFrame(names, "file_path string, byte_size bigint")


def write_texts(rows: DataFrame, root: str, order: list[str]) -> int:
    """Write rows (file_path, text) as files under a folder: the texts of a path in order, a line break after each.
    The number of files.

    Spark's writer names its files itself, so files of given names each take a folder of their own; these are made
    one by one, moved by the driver alone and listed folder by folder later. Here tasks write the files under their
    names. A file appears whole, by a rename, so a task that runs again leaves the same files.
    """
    fs, base = pa.fs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    dealt = rows.repartition("file_path").sortWithinPartitions("file_path", *order).select("file_path", "text")
    return dealt.mapInArrow(_writer(root), "files bigint").agg(F.sum("files")).first()[0] or 0


def _writer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(root)
        made, count, path, hidden, file = set(), 0, None, None, None

        def finish() -> None:
            if file is not None:
                file.close()
                fs.move(hidden, path)

        for batch in batches:
            for name, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                if f"{base}/{name}" != path:
                    finish()
                    path = f"{base}/{name}"
                    folder, _, last = path.rpartition("/")
                    if folder not in made:
                        fs.create_dir(folder, recursive=True)
                        made.add(folder)
                    hidden = f"{folder}/.{last}.{uuid.uuid4().hex}"
                    file, count = fs.open_output_stream(hidden), count + 1
                file.write((text or "").encode() + b"\n")
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([count])], names=["files"])
    return run


def detect_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of("file_path"))


def file_facts(files: DataFrame) -> DataFrame:
    """Content hash, line count (newlines + 1) and size in bytes; a scan's own hash and size stay."""
    newlines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    facts = {"content_hash": F.sha2("content", 256), "line_count": (newlines + 1).cast("bigint"),
             "byte_size": F.octet_length("content").cast("bigint")}
    return files.withColumns({k: v for k, v in facts.items() if k not in files.columns})


def file_rows(files: DataFrame, indexed_at) -> DataFrame:
    """Rows of the files table for scanned files of known language."""
    known = file_facts(detect_language(files)).where("language is not null")
    error = F.col("error_message") if "error_message" in known.columns else F.lit(None).cast("string")
    return known.select(
        row_id(*FILE_KEY).alias("file_id"), *FILE_KEY, "language", "content_hash",
        F.col("line_count").cast("int"), "byte_size", indexed_at.alias("indexed_at"),
        F.lit(None).cast("double").alias("parse_duration_ms"), error.alias("error_message"))


def diff_files(scan: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """Status per path: new, changed, unchanged, failed, unsupported_language or file_not_found.

    `scan` has content_hash and language, and error_message where reading may fail; `indexed` is the
    raw versioned files table. Only projects of the scan can miss a file.
    """
    scanned = scan.select(F.col("project_id").alias("_project")).distinct()
    known = latest_by_key(
        indexed.join(scanned, F.col("project_id") == F.col("_project"), "left_semi")
        .select(*FILE_KEY, "content_hash", "indexed_at"), FILE_KEY, "indexed_at", ["content_hash"])
    error = F.col("error_message") if "error_message" in scan.columns else F.lit(None).cast("string")
    s = scan.select(*FILE_KEY, F.col("content_hash").alias("new_hash"), "language",
                    F.lit(True).alias("_here"), error.alias("_error"))
    k = known.select(*FILE_KEY, F.col("content_hash").alias("old_hash"), F.lit(True).alias("_known"))
    unchanged = "changed" if force else "unchanged"
    status = (F.when(F.col("_here").isNull(), "file_not_found")
              .when(F.col("language").isNull(), "unsupported_language")
              .when(F.col("_error").isNotNull(), "failed")
              .when(F.col("_known").isNull(), "new")
              .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), unchanged)
              .otherwise("changed"))
    return s.join(k, FILE_KEY, "full_outer").select(*FILE_KEY, status.alias("status"), "new_hash")


def files_to_index(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("status").isin("new", "changed")).select(*FILE_KEY)


def files_with(diff: DataFrame, *statuses: str) -> DataFrame:
    return diff.where(F.col("status").isin(*statuses)).select(*FILE_KEY)


def replace_files(table: DataFrame, new_rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Old rows of re-indexed files go, their new rows come."""
    keep = table.join(changed.select(*FILE_KEY).distinct(), FILE_KEY, "left_anti")
    return keep.unionByName(new_rows.select(*table.columns))


def index_run_stats(diff: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """Files indexed / skipped / failed and rows extracted per kind, as (metric, value)."""
    status = F.col("status")
    files = diff.agg(
        F.count_if(status.isin("new", "changed")).alias("files_indexed"),
        F.count_if(status.isin("unchanged", "unsupported_language", "file_not_found"))
        .alias("files_skipped"),
        F.count_if(status == "failed").alias("files_failed"))
    names = files.columns
    out = files.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m"))
    out = out.select("m.metric", "m.value")
    for name, df in entities.items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("value"))
                              .select(F.lit(f"{name}_extracted").alias("metric"), "value"))
    return out
