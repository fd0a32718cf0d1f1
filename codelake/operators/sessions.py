"""Conversation sessions: numbered messages, rollups, listing, archiving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.operators.skew import numbered
from codelake.operators.versions import apply_changes, latest_by_key

ROLES = ["user", "assistant", "system"]


def append_messages(existing: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """The batch with sequence numbers that continue each session's own count.

    `order` is the arrival order within a session, of any type that sorts. A session may receive any
    number of rows; its existing maximum is one row.
    """
    highest = existing.groupBy("session_id").agg(F.max("sequence_number").alias("_base"))
    rows = numbered(batch, ["session_id"], order, [], "_n")
    return rows.join(highest, "session_id", "left").select(
        *batch.columns,
        (F.col("_n") + F.coalesce("_base", F.lit(0))).cast("bigint").alias("sequence_number"))


def session_rollup(messages: DataFrame, time: str | None = None,
                   roles: list[str] = ROLES) -> DataFrame:
    """Message and token counts per session, overall and per role; partial sums first."""
    sums = [F.count(F.lit(1)).alias("message_count"),
            F.sum("token_count").cast("bigint").alias("token_count")]
    if time:
        sums += [F.min(time).alias("first_at"), F.max(time).alias("last_at")]
    sums += [F.count_if(F.col("role") == r).alias(f"{r}_messages") for r in roles]
    return messages.groupBy("project_id", "session_id").agg(*sums)


def merge_rollups(parts: DataFrame) -> DataFrame:
    """Add up partial rollups of the same sessions; first and last times are kept where given."""
    counts = [c for c in parts.columns if c.endswith("_count") or c.endswith("_messages")]
    times = [agg(c).alias(c) for c, agg in (("first_at", F.min), ("last_at", F.max)) if c in parts.columns]
    return parts.groupBy("project_id", "session_id").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in counts], *times)


def move_counters(sessions: DataFrame, appended: DataFrame, now) -> DataFrame:
    """Session rows after messages were appended: counts, tokens and updated_at move.

    `appended` holds the new messages only; its rollup is one row per session."""
    added = session_rollup(appended).select(
        F.col("session_id").alias("_session"), F.col("message_count").alias("_messages"),
        F.coalesce("token_count", F.lit(0)).alias("_tokens"))
    joined = sessions.join(added, F.col("session_id") == F.col("_session"), "left")
    moved = {"message_count": F.coalesce("message_count", F.lit(0)) + F.coalesce("_messages", F.lit(0)),
             "token_count": F.coalesce("token_count", F.lit(0)) + F.coalesce("_tokens", F.lit(0)),
             "updated_at": F.when(F.col("_session").isNotNull(), now).otherwise(F.col("updated_at"))}
    return joined.select(*[moved[c].cast(sessions.schema[c].dataType).alias(c) if c in moved else F.col(c)
                           for c in sessions.columns])


def session_messages(messages: DataFrame, sessions: DataFrame, limit: int = 100) -> DataFrame:
    """The first `limit` messages of each wanted session in order."""
    w = Window.partitionBy("session_id").orderBy("sequence_number")
    return (messages.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")
            .orderBy("session_id", "sequence_number"))


def list_sessions(sessions: DataFrame, project: str, include_archived: bool = False,
                  limit: int = 50) -> DataFrame:
    """Newest sessions of a project first."""
    newest = latest_by_key(sessions.where(F.col("project_id") == project),
                           ["project_id", "session_id"], "updated_at")
    if not include_archived:
        newest = newest.where("archived_at is null")
    return newest.orderBy(F.desc("updated_at"), "session_id").limit(limit)


def archive_sessions(sessions: DataFrame, ids: DataFrame, at) -> DataFrame:
    """Mark sessions as archived; rows stay and unknown ids fail the job."""
    changes = ids.select("project_id", "session_id", at.alias("archived_at"),
                         at.alias("updated_at"))
    return apply_changes(sessions, changes, ["project_id", "session_id"], missing="error")
