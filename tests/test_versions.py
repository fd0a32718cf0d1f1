import random

import pytest
from pyspark.sql import functions as F

from codelake.operators import sessions as S
from codelake.operators import versions as V


def test_latest_breaks_ties_and_groups_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "z"), (2, None, "c")],
                               "k int, v int, t string")
    once = V.latest_by_key(df, ["k"], "v", ["t"])
    assert sorted(once.collect()) == [(1, 5, "b"), (2, None, "c")]
    assert sorted(V.latest_by_key(once, ["k"], "v", ["t"]).collect()) == sorted(once.collect())
    assert "WindowGroupLimit" in once._jdf.queryExecution().executedPlan().toString()


def test_apply_changes(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, created_at int")
    changes = spark.createDataFrame([(2, None, 99), (3, "c", 30)],
                                    "id int, name string, created_at int")
    got = sorted(V.apply_changes(base, changes, ["id"]).collect())
    assert got == [(1, "a", 10), (2, "b", 20), (3, "c", 30)]
    with pytest.raises(Exception, match="unknown key: 3"):
        V.apply_changes(base, changes, ["id"], missing="error").collect()


def hot_rows(spark, n=4000):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(40)}", rnd.randrange(900), i)
            for i in range(n)]
    return spark.createDataFrame(rows + [(None, 1, -1), (None, 2, -2)],
                                 "key string, at int, id int")


@pytest.mark.parametrize("kind", ["int", "string"])
def test_history_numbers_a_hot_key_over_many_parts(spark, kind):
    df = hot_rows(spark).withColumn("at", F.format_string("%05d", "at") if kind == "string" else F.col("at"))
    got = V.version_history(df, ["key"], "at", "id", ["id"])
    want, last = [], {}
    for r in sorted(df.collect(), key=lambda r: (str(r.key), r.at, r.id)):
        number, before = last.get(r.key, (0, None))
        last[r.key] = number + 1, r.id
        want.append((r.key, r.at, r.id, number + 1, before))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert "_part" in got._jdf.queryExecution().analyzed().toString()


def test_two_changes_for_a_key(spark):
    base = spark.createDataFrame([(1, "a", 10)], "id int, name string, at int")
    changes = spark.createDataFrame([(1, "b", 11), (1, "c", 12), (2, "d", 1)], base.schema)
    got = V.apply_changes(base, changes, ["id"], version="at")
    assert sorted(got.collect()) == [(1, "c", 12), (2, "d", 1)]
    with pytest.raises(Exception, match="several changes for key 1"):
        V.apply_changes(base, changes, ["id"]).collect()


def test_history_with_repeated_values_and_columns_of_the_order(spark):
    df = spark.range(3000).select(F.lit("one").alias("key"), (F.col("id") % 3).alias("at"), "id")
    got = V.version_history(df, ["key"], "at", "id", ["id"])
    rows = sorted(map(tuple, got.select("version_no", "id", "previous_value").collect()))
    ids = sorted(range(3000), key=lambda i: (i % 3, i))
    assert rows == [(n + 1, i, ids[n - 1] if n else None) for n, i in enumerate(ids)]


def test_messages_continue_their_session(spark):
    rows = hot_rows(spark, 1500).where("key is not null").select(
        F.col("key").alias("session_id"), F.col("id").alias("turn"))
    old = rows.where("turn < 500").withColumn("sequence_number", F.col("turn").cast("bigint"))
    got = S.append_messages(old, rows.where("turn >= 500"), "turn")
    for r in got.groupBy("session_id").agg(
            F.sort_array(F.collect_list(F.struct("turn", "sequence_number"))).alias("m")).collect():
        top = old.where(F.col("session_id") == r.session_id).agg(
            F.max("sequence_number")).first()[0] if r.session_id == "hot" else None
        numbers = [m.sequence_number for m in r.m]
        assert numbers == list(range(numbers[0], numbers[0] + len(numbers)))
        if top is not None:
            assert numbers[0] == top + 1


def test_cascade_delete(spark):
    a = spark.createDataFrame([("p", 1), ("q", 2), (None, 3)], "project_id string, n int")
    keys = spark.createDataFrame([("p",), ("p",)], "id string")
    kept, counts = V.cascade_delete({"a": (a, "project_id"), "b": (a, "project_id")},
                                    {"a": keys, "b": keys})
    assert sorted(r.n for r in kept["a"].collect()) == [2, 3]
    assert sorted(map(tuple, counts.collect())) == [("a", 1), ("b", 1)]


def test_insert_absent(spark):
    base = spark.createDataFrame([("a", "1")], "key string, value string")
    new = spark.createDataFrame([("a", "2"), ("b", "3")], "key string, value string")
    assert V.insert_absent(base, new, ["key"]).collect() == [("b", "3")]


def test_counters_move_with_an_append(spark):
    day = F.lit("2024-05-01").cast("timestamp")
    sessions = spark.createDataFrame([("s", "p", 2, 10), ("t", "p", None, None)],
                                     "session_id string, project_id string, message_count int, token_count long"
                                     ).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    new = spark.createDataFrame([("p", "s", "user", 5), ("p", "s", "tool", None)],
                                "project_id string, session_id string, role string, token_count long")
    got = {r.session_id: r for r in S.move_counters(sessions, new, day).collect()}
    assert (got["s"].message_count, got["s"].token_count, got["s"].updated_at.month) == (4, 15, 5)
    assert (got["t"].message_count, got["t"].updated_at.month) == (0, 1)
