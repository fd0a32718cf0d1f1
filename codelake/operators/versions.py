"""Versioned rows: newest per key, partial updates, history, cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.operators.skew import numbered


def latest_by_key(df: DataFrame, keys: list[str], version: str,
                  tie_break: list[str] | None = None) -> DataFrame:
    """Newest row per key.

    The rank filter becomes a group limit on both sides of the shuffle, so every task sends at
    most one row per key: a key with a third of all rows costs no more than any other.
    """
    order = [F.col(c).desc_nulls_last() for c in [version, *(tie_break or [])]]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def apply_changes(base: DataFrame, changes: DataFrame, keys: list[str],
                  missing: str = "insert", version: str | None = None,
                  defaults: dict[str, Column] | None = None,
                  keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Partial update: a NULL in the change leaves the old value; unknown keys are inserted.

    missing='error' fails the job on an unknown key instead. `defaults` fill what is still NULL
    and `keep` names columns an update must not touch. Of several changes for a key the newest
    `version` counts; without one they fail the job, since their order is unknown.
    """
    if version is not None:
        changes = latest_by_key(changes, keys, version)
    else:
        changes = _one_per_key(changes, keys)
    defaults = defaults or {}
    b, c = base.alias("b"), changes.alias("c")
    is_new = F.col("b._seen").isNull()
    joined = (b.withColumn("_seen", F.lit(True)).alias("b")
              .join(c, [F.col(f"b.{k}") == F.col(f"c.{k}") for k in keys], "full_outer"))
    columns = []
    for name in base.columns:
        old = F.col(f"b.{name}")
        if name in keys and missing == "error":
            refuse = F.raise_error(F.concat(F.lit("unknown key: "),
                                            F.col(f"c.{name}").cast("string")))
            value = F.when(is_new, refuse.cast(base.schema[name].dataType)).otherwise(old)
        elif name not in changes.columns:
            value = old
        elif name in keep or name in keys:
            value = F.coalesce(old, F.col(f"c.{name}"))
        else:
            value = F.coalesce(F.col(f"c.{name}"), old)
        if name in defaults:
            value = F.coalesce(value, defaults[name])
        columns.append(value.cast(base.schema[name].dataType).alias(name))
    return joined.select(*columns)


def _one_per_key(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The changes, or a failed job where a key has two."""
    turn = Window.partitionBy(*keys).orderBy(*keys)
    refuse = F.raise_error(F.concat_ws(" ", F.lit("several changes for key"),
                                       *[F.col(k).cast("string") for k in keys]))
    return (changes.withColumn("_turn", F.row_number().over(turn)).where("_turn <= 2")
            .where(F.when(F.col("_turn") == 2, refuse.cast("boolean")).otherwise(True)).drop("_turn"))


def insert_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table does not hold yet (initial metadata)."""
    return rows.join(base.select(*keys), keys, "left_anti").dropDuplicates(keys)


def version_history(df: DataFrame, keys: list[str], version: str, value: str,
                    ties: list[str] | None = None) -> DataFrame:
    """All versions numbered from the oldest, each with the value it replaced."""
    return numbered(df, keys, version, ties or [], "version_no", {"previous_value": value})


def cascade_delete(tables: dict[str, tuple[DataFrame, str]],
                   keys: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Drop the keyed rows from every table.

    `tables` maps name -> (rows, key column); `keys` maps name -> one-column frame of doomed keys.
    Returns the surviving rows per table and one frame of removed counts.
    """
    kept, counts = {}, None
    for name, (df, column) in tables.items():
        doomed = keys[name].toDF("_doomed").distinct()
        on = F.col(column) == F.col("_doomed")
        kept[name] = df.join(doomed, on, "left_anti")
        removed = (df.join(doomed, on, "left_semi").agg(F.count(F.lit(1)).alias("removed"))
                   .select(F.lit(name).alias("table_name"), "removed"))
        counts = removed if counts is None else counts.unionByName(removed)
    return kept, counts
