"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the node, so a node with very many neighbours is only
ever one long run of slim rows, which adaptive execution may split. Every step is written to the
shared folder; nothing but one checksum a step reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v) with u > v. large: hang the larger neighbours of each node on its smallest one;
    else hang each node and its smaller neighbours there."""
    if large:
        around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        out = around.where("v > u").join(least, "u").select(F.col("v").alias("u"),
                                                            F.col("m").alias("v"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        out = (pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(least.select("u", F.col("m").alias("v"))))
    return out.where("u > v").distinct()


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable."""
    pairs = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"),
                                                F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(pairs)
    while mark[0]:
        pairs = stored(_star(_star(pairs, True), False), "links")
        last, mark = mark, _mark(pairs)
        if last == mark:
            break
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
