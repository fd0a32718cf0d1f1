"""Ordered numbering that survives a key holding a large share of the rows.

A plain window puts all rows of one key into one task. Here the rows are range-partitioned by key and
order and stored, so that a key with many rows spans many parts; they are numbered within each part,
and the counts of the parts before are carried forward. There is one path for every size, and the
order column may have any type that sorts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.session import new_folder


def numbered(df: DataFrame, keys: list[str], order: str, ties: list[str], number: str,
             previous: dict[str, str] | None = None) -> DataFrame:
    """row_number per key in `order`, `ties`; `previous` maps new column -> lagged column."""
    previous = previous or {}
    spark = df.sparkSession
    path = new_folder(spark, "numbered")
    (df.repartitionByRange(*keys, order, *ties)
     .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
     .write.parquet(path))
    rows = spark.read.parquet(path)
    inside = Window.partitionBy(*keys, "_part").orderBy(order, *ties, "_row")
    local = rows.select("*", F.row_number().over(inside).cast("bigint").alias("_rn"),
                        *[F.lag(c).over(inside).alias(n) for n, c in previous.items()])
    at = F.struct(order, *ties, "_row")
    sums = rows.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(F.struct(F.col(c).alias("v")), at).alias(f"_last_{n}") for n, c in previous.items()])
    parts = Window.partitionBy(*keys).orderBy("_part")  # one short row for each part of a key
    carried = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
        (F.sum("_n").over(parts) - F.col("_n")).alias("_before"),
        *[F.lag(f"_last_{n}").over(parts).alias(f"_carry_{n}") for n in previous],
    ).where("_before > 0")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = local.join(carried, [*same, F.col("_part") == F.col("_p")], "left")
    return joined.select(
        *df.columns, (F.col("_rn") + F.coalesce("_before", F.lit(0))).alias(number),
        *[F.when(F.col("_rn") == 1, F.col(f"_carry_{n}.v")).otherwise(F.col(n)).alias(n)
          for n in previous])
