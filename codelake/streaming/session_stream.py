"""Session rollups and gap-based sessions kept current while messages arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelake.operators.sessions import merge_rollups, session_rollup


def _timed(source: DataFrame, time: str, delay: str, identity: list[str], later: int = 0) -> DataFrame:
    """source with its time, `later` days on, as _t and without repeats; ids are remembered no longer than the delay."""
    at = F.col(time).cast("timestamp") + F.make_dt_interval(F.lit(later))
    return source.withColumn("_t", at).withWatermark("_t", delay).dropDuplicatesWithinWatermark(identity)


#: Spark's first watermark is the start of 1970, and what is not after it counts as late: 400 years.
_AFTER_1970 = 146_097


def counters(query: StreamingQuery) -> dict[str, int | list[int]]:
    """Rows that came too late in all batches of a run, and the rows of state after each batch."""
    operators = [p["stateOperators"] for p in query.recentProgress]
    return {"too_late": sum(o["numRowsDroppedByWatermark"] for batch in operators for o in batch),
            "state_rows": [sum(o["numRowsTotal"] for o in batch) for batch in operators]}


def stream_session_rollup(source: DataFrame, target: str, checkpoint: str, identity: list[str],
                          time: str | None = None, delay: str = "1 day") -> dict[str, int | list[int]]:
    """Add a stream of messages to partial rollups until it is drained; the counters of the run.

    Repeated messages are dropped by identity in the state store (a cluster sets the RocksDB
    provider in spark.sql.streaming.stateStore.providerClass). With a time column the state is bounded:
    a message is remembered for `delay` of event time, and one that is later than that is left out and
    counted. Without one, every identity is remembered. Every micro-batch writes the partial sums of its new
    messages to its own batch_id folder, so a repeated batch replaces itself. Only partial sums leave a batch: a
    session with a third of all messages costs one row per task. `compact_rollup` adds the sums up.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        part = session_rollup(batch, time).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        (part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(target))

    rows = source.dropDuplicates(identity) if time is None else _timed(
        source, time, delay, identity, _AFTER_1970).drop("_t")
    query = (rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return counters(query)


def _compacted(target: str) -> str:
    return f"{target}-compacted"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _upto(spark: SparkSession, target: str) -> int:
    """The last batch whose sums are in the compacted rollups; -1 without any."""
    if not _exists(spark, _compacted(target)):
        return -1
    row = spark.read.parquet(_compacted(target)).agg(F.max("upto")).first()
    return -1 if row[0] is None else int(row[0])


def _parts(spark: SparkSession, target: str) -> DataFrame:
    """The newest compacted sums and the sums of the batches after them."""
    upto = _upto(spark, target)
    later = spark.read.parquet(target).where(F.col("batch_id") > upto).drop("batch_id")
    if upto < 0:
        return later
    return spark.read.parquet(_compacted(target)).where(F.col("upto") == upto).drop("upto").unionByName(later)


def current_rollup(spark: SparkSession, target: str) -> DataFrame:
    return merge_rollups(_parts(spark, target))


def compact_rollup(spark: SparkSession, target: str) -> int:
    """Add up all partial sums written so far, so that a reader meets one row per session again.

    The sums go to a folder named by the last batch in them; readers take the newest such folder and the
    batches after it, so a compaction counts as soon as its job commits, and one that breaks off or runs twice
    changes nothing. Sums that are no longer read are deleted afterwards. Returns that last batch."""
    last = spark.read.parquet(target).agg(F.max("batch_id")).first()[0]
    before = _upto(spark, target)
    if last is None or last <= before:
        return before
    (merge_rollups(_parts(spark, target)).withColumn("upto", F.lit(int(last)).cast("bigint"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upto").parquet(_compacted(target)))
    fs = spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    # the last batch stays, so that the folder keeps its schema
    for folder, name, first_kept in ((target, "batch_id", last), (_compacted(target), "upto", last)):
        for status in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder)):
            label, _, number = status.getPath().getName().partition("=")
            if label == name and number.isdigit() and int(number) < first_kept:
                fs.delete(status.getPath(), True)
    return int(last)


def stream_activity(source: DataFrame, target: str, checkpoint: str, time: str, identity: str,
                    delay: str = "1 day", width: str = "1 day") -> None:
    """Counts per window and type for messages with a time column.

    The watermark bounds both the set of remembered ids and the open windows; a window is written
    once, when it can no longer change.
    """
    counts = (_timed(source, time, delay, [identity])
              .groupBy(F.window("_t", width).alias("_w"), "event_type")
              .agg(F.count(F.lit(1)).alias("messages"))
              .select(F.col("_w.start").alias("window_start"), "event_type", "messages"))
    (counts.writeStream.outputMode("append").format("parquet").option("path", target)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
     .awaitTermination())


def stream_sessions(source: DataFrame, target: str, checkpoint: str, keys: list[str], time: str, identity: list[str],
                    gap: str = "30 minutes", delay: str = "1 day", sums: dict[str, str] | None = None) -> dict[str, int | list[int]]:
    """Sessions of a key, cut where nothing happens for longer than a gap; the counters of the run.

    A row that comes late but within `delay` extends or joins sessions that are still open; one that is later
    than that is left out and counted. A session is written once, when the watermark has passed its last row
    by the gap, and then leaves the state, as do remembered ids: the state holds what is open, however long the
    stream runs. With spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition (set in SETTINGS) the rows
    of a task are merged to sessions before they are shuffled, so a key with a third of all rows sends few.
    `sums` names columns to add up: result -> column.
    """
    totals = [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    sessions = (_timed(source, time, delay, identity)
                .groupBy(*keys, F.session_window("_t", gap).alias("_w"))
                .agg(F.count(F.lit(1)).alias("events"), F.min("_t").alias("first_at"), F.max("_t").alias("last_at"),
                     *totals)
                .drop("_w"))
    query = (sessions.writeStream.outputMode("append").format("parquet").option("path", target)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return counters(query)
