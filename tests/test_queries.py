"""Registered queries against their expected SQL on the smallest data."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from codelake.plans.registered import TABLES
from tools.compare import rows_of

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_expected_text_has_a_query():
    assert set(SQL) <= set(QUERIES)
    ours = {q for q in QUERIES if not q.startswith("op") and q != "pipeline"}
    assert ours - set(SQL) == {"t7_table_bytes", "p6_approx_distinct"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(
        names, result.fetchall())


def test_rewritten_buckets_lose_one_project(spark, tmp_path):
    """Parts 60 to 89 are the files of proj-2, of which 60 and 75 are edited as well."""
    part = spark.range(1, 121).select(
        F.col("id").alias("p_partkey"), F.lit("part").alias("p_name"), F.lit("b").alias("p_brand"),
        F.lit("t").alias("p_type"), F.lit(3).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    kept = {int(r.file_path.split("/m")[1].split(".")[0]) for r in QUERIES["i6_rewrite_buckets"](
        spark, str(tmp_path)).where("name = 'added' or kind = 'class'").collect()}
    assert kept == set(range(1, 121)) - set(range(60, 90))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
