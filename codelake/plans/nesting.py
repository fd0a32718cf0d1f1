"""Nested spans without pairwise comparison.

Spans of one file that nest properly are read as open and close events in order. The running
count of open spans is the depth, and at each depth the last span opened before a position is the
one that holds it, so parents and containing scopes come from running windows. No join on a
between condition, and no pairs of a row with every span of its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.plans.lines import KEY, PAST, by_file


def nest(spans: DataFrame, start: str, end: str, label: list[str]) -> DataFrame:
    """Add `depth` (1 = outermost) and `chain`, the labels of the enclosing spans from outside in.

    `start` and `end` are inclusive positions; nested spans share at most one of the two.
    """
    size = F.col(end) - F.col(start)
    events = spans.select(*KEY, F.struct(*spans.columns).alias("_s"), F.explode(F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("step"), (-size).alias("rank")),
        F.struct((F.col(end) + 1).alias("at"), F.lit(-1).alias("step"), size.alias("rank"))))
        .alias("e"))
    events = events.select(*KEY, F.col("e.step").alias("_step"), F.struct(
        "e.at", "e.step", "e.rank").alias("_o"), "_s")
    depth = F.sum("_step").over(by_file("_o").rowsBetween(PAST, 0)).cast("int")
    opened = events.withColumn("depth", depth).where("_step = 1")
    placed = opened.select("*", F.explode(F.sequence(F.lit(1), "depth")).alias("_at"))
    owner = F.when(F.col("_at") == F.col("depth"), F.struct(
        F.col("_at"), *[F.col(f"_s.{c}").alias(c) for c in label]))
    w = Window.partitionBy(*KEY, "_at").orderBy("_o").rowsBetween(PAST, -1)
    placed = placed.withColumn("_owner", F.last(owner, True).over(w))
    own = F.col("_at") == F.col("depth")
    grouped = placed.groupBy(*KEY, "_o").agg(
        F.first("_s").alias("_s"), F.max("depth").alias("depth"),
        F.sort_array(F.collect_list(F.when(~own, F.col("_owner")))).alias("chain"))
    return grouped.select(*KEY, *[F.col(f"_s.{c}").alias(c) for c in spans.columns
                                  if c not in KEY], "depth", "chain")


def innermost_scope(rows: DataFrame, line: str, scopes: DataFrame,
                    take: dict[str, str] | None = None) -> DataFrame:
    """Give each row the deepest scope whose lines hold it: its scope_id, or the columns `take`
    names (scope column -> new column).

    The answer only changes where a scope starts or has just ended. It is worked out for those
    breakpoints, depth by depth, and carried forward to the rows by one running window, so the
    large side is sorted once and never multiplied. Equal depth on one line: the later start.
    """
    take = take or {"scope_id": "scope_id"}
    labels = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    s = scopes.select(*KEY, "start_line", "end_line", "depth", labels.alias("_label"),
                      F.max("depth").over(Window.partitionBy(*KEY)).alias("_deepest"))

    def event(at, depth, kind, scope):
        return F.struct(at.alias("line"), depth.alias("depth"), F.lit(kind).alias("kind"),
                        scope.alias("scope"))

    mine = F.struct(F.col("end_line"), F.col("_label"))
    start, after = F.col("start_line"), F.col("end_line") + 1
    breaks = F.flatten(F.transform(F.sequence(F.lit(0), F.col("_deepest")), lambda d: F.array(*[
        event(at, d, 1, F.when(F.lit(False), mine)) for at in (start, after)])))
    events = s.select(*KEY, F.explode(F.concat(
        F.array(event(start, F.col("depth"), 0, F.when(F.lit(True), mine))), breaks)).alias("e"))
    events = events.select(*KEY, "e.*")
    by_depth = Window.partitionBy(*KEY, "depth").orderBy("line", "kind", "scope")
    looked = events.withColumn("_found", F.last("scope", True).over(
        by_depth.rowsBetween(PAST, 0))).where("kind = 1")
    holds = F.col("_found.end_line") >= F.col("line")
    best = looked.groupBy(*KEY, "line").agg(
        F.max(F.when(holds, F.struct("depth", "_found._label"))).alias("_best"))
    carried = [c for c in rows.columns if c not in KEY and c not in take.values()]
    row, label = F.struct(*carried), F.struct(F.col("_best._label").alias("x"))
    left = best.select(*KEY, F.col("line").alias("_line"), F.lit(0).alias("_kind"),
                       label.alias("_b"))
    right = rows.select(*KEY, F.col(line).alias("_line"), F.lit(1).alias("_kind"),
                        row.alias("_r"))
    w = Window.partitionBy(*KEY).orderBy("_line", "_kind").rowsBetween(PAST, 0)
    out = left.unionByName(right, allowMissingColumns=True).withColumn(
        "_l", F.last("_b", True).over(w)).where("_kind = 1")
    out = out.select(*KEY, *[F.col(f"_r.{c}").alias(c) for c in carried],
                     *[F.col(f"_l.x.{n}").alias(n) for n in take.values()])
    return out.select(*[c for c in rows.columns], *[
        n for n in take.values() if n not in rows.columns])
