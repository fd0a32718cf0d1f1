"""Continuous indexing of arriving file rows.

What is known of a file, its newest arrival and content hash, lies in Spark's state store, so a
micro-batch reads its own rows and that state and nothing that earlier batches wrote. (A cluster names the
RocksDB provider in spark.sql.streaming.stateStore.providerClass, which keeps the entries on disk.)

Spark's call of a Python function for a group costs milliseconds, whatever the group holds. Files are therefore
dealt to a fixed number of buckets by hash of their key, and an entry of the state store holds what is known of all
files of a bucket, packed to 56 bytes a file. A batch touches the buckets of its own files only.

A row without content is a deletion. Of several rows of a file in a batch the newest arrival counts; rows
that arrive late, with an older arrival than the state knows, change nothing, and neither does a newer row
with the same content. All rows of a bucket in a batch go to one task, which keeps a single row of each file.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codelake.operators.versions import latest_by_key
from codelake.plans.index import write_entities
from codelake.plans.lines import key_numbers
from codelake.sources.scan import FILE_KEY, detect_language, file_facts, file_rows
from codelake.sources.tables import TableStore

FILES = ("project_id string, file_path string, language string, content_hash string, "
         "line_count bigint, byte_size bigint, batch_id bigint")
CHANGED = ["project_id", "file_path", "content", "content_hash", "arrival"]
CHANGES = "project_id string, file_path string, content string, content_hash string, arrival bigint"


BUCKETS = 1 << 12  # fixed for a checkpoint, as the state is kept by bucket
KNOWN = struct.Struct("<qqq32s")  # of a file: the two numbers of its key, newest arrival, digest of the content
DELETED = bytes(32)


def _moved(newest: tuple, state) -> bool:
    """Whether the newest row of a file, told by (arrival, hash; empty: deleted), changes the content that the state
    knows. A newer arrival is noted in any case."""
    arrival, known = state.get if state.exists else (None, "")
    if arrival is not None and newest[0] <= arrival:
        return False
    state.update(newest)
    return newest[1] != known


def _newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest row of a file, if it changes what the state knows."""
    best, found = None, None
    for frame in frames:  # nearly all groups are one row, so columns are read as lists and rows are cut out by place
        order = list(zip(map(int, frame["arrival"].tolist()), frame["content_hash"].tolist(), strict=True))
        at = max(range(len(order)), key=order.__getitem__)
        if best is None or order[at] > best:
            best, found = order[at], frame.iloc[at:at + 1]
    if _moved(best, state):
        yield found[CHANGED]


class _Entry:
    """What is known of one file of a bucket, with the interface of a state."""

    def __init__(self, known: dict, file: tuple):
        self.known, self.file = known, file

    @property
    def exists(self) -> bool:
        return self.file in self.known

    @property
    def get(self) -> tuple:
        arrival, digest = self.known[self.file]
        return arrival, "" if digest == DELETED else digest.hex()

    def update(self, newest: tuple) -> None:
        self.known[self.file] = newest[0], bytes.fromhex(newest[1]) or DELETED


def _newest_of_bucket(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest row of each file of a bucket that changes what the state knows of it."""
    best: dict[tuple, tuple] = {}
    for frame in frames:
        files = zip(frame["_first"].tolist(), frame["_second"].tolist(), strict=True)
        order = zip(map(int, frame["arrival"].tolist()), frame["content_hash"].tolist(), strict=True)
        rows = zip(*[frame[c].tolist() for c in ("project_id", "file_path", "content")], strict=True)
        for file, newest, row in zip(files, order, rows, strict=True):
            if file not in best or newest > best[file][0]:
                best[file] = newest, row
    known = {(first, second): (arrival, digest) for first, second, arrival, digest
             in KNOWN.iter_unpack(state.get[0] if state.exists else b"")}
    changed = [(*row, newest[1], newest[0]) for file, (newest, row) in best.items() if _moved(newest, _Entry(known, file))]
    state.update((b"".join(KNOWN.pack(*file, *entry) for file, entry in known.items()),))
    if changed:
        yield pd.DataFrame(changed, columns=CHANGED)


def changed_files(source: DataFrame, order: str, buckets: int | None = BUCKETS) -> DataFrame:
    """The stream of files whose content moved: CHANGES, where a deleted file has no content and an empty
    hash. Without buckets each file is an entry of the state store of its own, for streams that bring few files at a
    time to an index of very many."""
    rows = detect_language(source).where("language is not null").select(
        *FILE_KEY, "content", F.coalesce(F.sha2("content", 256), F.lit("")).alias("content_hash"),
        F.col(order).cast("bigint").alias("arrival"))
    if buckets is None:
        return rows.groupBy(*FILE_KEY).applyInPandasWithState(
            _newest, CHANGES, "arrival bigint, content_hash string", "update", GroupStateTimeout.NoTimeout)
    first, second = key_numbers()
    return (rows.withColumns({"_first": first, "_second": second}).withColumn("_bucket", F.pmod("_first", F.lit(buckets)))
            .groupBy("_bucket").applyInPandasWithState(
                _newest_of_bucket, CHANGES, "known binary", "update", GroupStateTimeout.NoTimeout))


def _drain(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    (stream.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def stream_into_index(source: DataFrame, store: TableStore, checkpoint: str, order: str, indexed_at=None) -> None:
    """Keep the files table and the six entity tables current until a stream of (project_id, file_path,
    content, order) is drained.

    The old rows of a changed or deleted file go in the same rewrite that brings the new ones. Running a
    batch again replaces the same files by the same rows, so the tables are exactly what a batch run over the
    newest versions leaves."""
    when = F.current_timestamp() if indexed_at is None else indexed_at

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        files, gone = batch.where("content_hash <> ''"), batch.select(*FILE_KEY)
        if not batch.isEmpty():
            write_entities(store, files.select(*FILE_KEY, "content"), gone)
            store.bucketed("files").replace_files(file_rows(files, when), gone)
        batch.unpersist()

    _drain(changed_files(source, order), checkpoint, handle)


def current_files(spark: SparkSession, path: str) -> DataFrame:
    """Newest indexed row per file."""
    rows = spark.read.schema(T.StructType.fromDDL(FILES)).parquet(path)
    return latest_by_key(rows, FILE_KEY, "batch_id", ["content_hash"]).where("content_hash <> ''")


def stream_index(source: DataFrame, target: str, checkpoint: str, order: str,
                 on_changed=None) -> None:
    """Index a stream of (project_id, file_path, content, order) rows until it is drained.

    Each micro-batch writes the facts of the files that moved to its own batch_id folder. A repeated batch
    overwrites that folder, so the result is exactly-once. `on_changed(rows)` receives the changed
    files with their content.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        changed = file_facts(detect_language(batch.persist()))
        rows = changed.select(*FILE_KEY, "language", "content_hash", "line_count", "byte_size",
                              F.lit(batch_id).cast("bigint").alias("batch_id"))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(target))
        if on_changed is not None:
            on_changed(changed)
        batch.unpersist()

    _drain(changed_files(source, order), checkpoint, handle)
