"""Free SQL over the tables: one query per category, forwarded to Spark SQL as written.

Each entry is (SQL for Spark, SQL for the check, or None when the text is the same).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, tuple[str, str | None]] = {
    "p1_filter": ("""
        SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
        WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R')
          AND l_linestatus LIKE 'O%' AND l_discount IS NOT NULL AND NOT l_tax > 0.05""", None),
    "p2_inner_join": ("""
        SELECT n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""", None),
    "p3_outer_join": ("""
        SELECT c.c_custkey, count(o.o_orderkey) AS orders FROM customer c
        LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'
        GROUP BY c.c_custkey""", None),
    "p3_semi_anti": ("""
        SELECT c_custkey, 'has' AS side FROM customer LEFT SEMI JOIN orders
          ON o_custkey = c_custkey AND o_totalprice > 400000
        UNION ALL
        SELECT c_custkey, 'none' AS side FROM customer LEFT ANTI JOIN orders
          ON o_custkey = c_custkey AND o_totalprice > 400000""", """
        SELECT c_custkey, CASE WHEN c_custkey IN (
          SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'has' ELSE 'none' END
          AS side FROM customer"""),
    "p4_as_of": ("""
        SELECT event_id, user_id, last_error FROM (
          SELECT event_id, user_id, event_type,
            last(CASE WHEN event_type = 'error' THEN event_id END) IGNORE NULLS OVER (
              PARTITION BY user_id ORDER BY ts, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_error FROM events)
        WHERE event_type = 'click'""", """
        SELECT e.event_id, e.user_id, (SELECT arg_max(x.event_id, (x.ts, x.event_id))
          FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error'
            AND (x.ts, x.event_id) < (e.ts, e.event_id)) AS last_error
        FROM events e WHERE e.event_type = 'click'"""),
    "p4_range_join": ("""
        SELECT d.day_no, count(*) AS orders FROM (
          SELECT o_orderkey, datediff(o_orderdate, DATE'1995-01-01') AS d FROM orders) o
        JOIN (SELECT n_nationkey AS day_no, n_nationkey * 50 AS lo, n_nationkey * 50 + 60 AS hi
              FROM nation) d ON o.d BETWEEN d.lo AND d.hi GROUP BY d.day_no""", """
        SELECT d.day_no, count(*) AS orders FROM (
          SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS d
          FROM orders) o
        JOIN (SELECT n_nationkey AS day_no, n_nationkey * 50 AS lo, n_nationkey * 50 + 60 AS hi
              FROM nation) d ON o.d BETWEEN d.lo AND d.hi GROUP BY d.day_no"""),
    "p5_group_having": ("""
        SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty,
          round(avg(l_discount), 6) AS avg_discount FROM lineitem
        GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""", None),
    "p6_distinct": ("""
        SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers,
          count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag""", None),
    "p7_grouping_sets": ("""
        SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
        GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""", None),
    "p7_cube": ("""
        SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
        GROUP BY CUBE (o_orderstatus, o_orderpriority)""", None),
    "p7_rollup": ("""
        SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders
        GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""", None),
    "p8_windows": ("""
        SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS r,
          lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
          round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
            ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent FROM events""", None),
    "p9_top_k": ("""
        SELECT o_orderkey, o_totalprice FROM orders
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10""", None),
    "p10_set_operations": ("""
        SELECT 'both' AS side, k FROM (SELECT c_custkey AS k FROM customer
          INTERSECT SELECT o_custkey FROM orders)
        UNION ALL SELECT 'only' AS side, k FROM (SELECT c_custkey AS k FROM customer
          EXCEPT SELECT o_custkey FROM orders)""", None),
    "p11_text_and_dates": ("""
        SELECT date_format(date_trunc('MONTH', o_orderdate), 'yyyy-MM') AS month,
          upper(substr(o_orderpriority, 3)) AS priority, count(*) AS n,
          min(length(trim(o_orderpriority))) AS w FROM orders GROUP BY 1, 2""", """
        SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month,
          upper(substr(o_orderpriority, 3)) AS priority, count(*) AS n,
          min(length(trim(o_orderpriority))) AS w FROM orders GROUP BY 1, 2"""),
    "p12_math_and_casts": ("""
        SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 100) AS BIGINT) AS hundreds,
          round(abs(l_discount - l_tax), 4) AS gap,
          CASE WHEN l_quantity > 25 THEN 'big' WHEN l_quantity > 10 THEN 'mid' ELSE 'small' END
          AS size FROM lineitem""", None),
    "p13_arrays_and_json": ("""
        SELECT e.event_id, CAST(variant_get(parse_json(e.props), '$.k', 'int') AS BIGINT) AS k
        FROM events e""", """
        SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"""),
    "p13_embedding_values": ("""
        SELECT vec_id, CAST(size(embedding) AS BIGINT) AS dims, CAST(aggregate(transform(embedding,
          x -> CASE WHEN x > 0 THEN 1 ELSE 0 END), 0, (a, x) -> a + x) AS BIGINT) AS positive
        FROM embeddings""", """
        SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims,
          CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive
        FROM embeddings"""),
    "p14_subqueries": ("""
        WITH big AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders o
          WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders))
        SELECT b.o_orderkey, b.o_custkey FROM big b WHERE EXISTS (
          SELECT 1 FROM lineitem l WHERE l.l_orderkey = b.o_orderkey AND l.l_quantity > 45)""",
                       None),
}
# Approximate counts have no exact counterpart to compare with.
ROWS_ONLY = {
    "p6_approx_distinct": """
        SELECT l_returnflag, approx_count_distinct(l_partkey) AS parts FROM lineitem
        GROUP BY l_returnflag""",
}
_TABLE = re.compile(r"\b(FROM|JOIN)\s+(lineitem|orders|customer|nation|events|embeddings)\b")


def run(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """Run SQL with the tables bound to this query alone."""
    names = {m.group(2) for m in _TABLE.finditer(text)}
    frames = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in names}
    return spark.sql(_TABLE.sub(r"\1 {\2}", text), **frames)


def queries():
    texts = {**{k: v[0] for k, v in SQL.items()}, **ROWS_ONLY}
    return {k: (lambda spark, sf, t=t: run(spark, sf, t)) for k, t in texts.items()}


def expected() -> dict[str, str]:
    return {k: own or text for k, (text, own) in SQL.items()}
