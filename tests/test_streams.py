from pyspark.sql import functions as F

from codelake.operators import sessions as S
from codelake.operators import todos as K
from codelake.streaming import index_stream, session_stream


def test_streamed_rollup_equals_batch_and_drops_repeats(spark, tmp_path):
    rows = spark.range(200).select(
        (F.col("id") % 7).cast("string").alias("session_id"), F.lit("p").alias("project_id"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        (F.col("id") % 5).alias("token_count"), F.col("id").alias("turn"))
    for part in (rows.where("id < 120"), rows.where("id >= 60")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        session_stream.stream_session_rollup(source, str(tmp_path / "out"),
                                             str(tmp_path / "ck"), ["session_id", "turn"])
    batch = S.session_rollup(rows)
    got = session_stream.current_rollup(spark, str(tmp_path / "out")).select(batch.columns)
    assert sorted(got.collect()) == sorted(batch.collect())


def test_stream_index_keeps_the_newest_and_skips_repeats(spark, tmp_path):
    schema = "project_id string, file_path string, content string, arrival int"
    seen = []
    drops = [[("p", "a.py", "x", 1), ("p", "a.py", "y", 2), ("p", "n.md", "z", 1)],
             [("p", "a.py", "y", 3)], [("p", "a.py", "w\n", 4), ("q", "a.py", "y", 4)]]
    for drop in drops:
        spark.createDataFrame(drop, schema).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        index_stream.stream_index(
            source, str(tmp_path / "files"), str(tmp_path / "ck"), "arrival",
            lambda rows: seen.append(sorted((r.project_id, r.content) for r in rows.collect())))
    assert seen == [[("p", "y")], [], [("p", "w\n"), ("q", "y")]]
    got = index_stream.current_files(spark, str(tmp_path / "files"))
    assert sorted((r.project_id, r.line_count) for r in got.collect()) == [("p", 2), ("q", 1)]


def _tables(store):
    from codelake.plans.index import ENTITIES
    out = {}
    for name in (*ENTITIES, "files"):
        rows = store.read(name)
        out[name] = sorted(str(r) for r in rows.drop("indexed_at").collect())
    return out


def test_stream_keeps_every_entity_table(spark, tmp_path):
    """Edits, repeats, a late older version and a deletion leave what a batch run leaves."""
    from codelake.plans.index import index_project
    from codelake.sources.tables import TableStore
    schema = "project_id string, file_path string, content string, arrival int"
    a1, a2 = "import os\n\ndef one(x: int):\n    return os\n", "class Two:\n    def go(self): pass\n"
    b = "import { q } from './a';\nexport class Q { run() { return 1; } }\n"
    drops = [[("p", "a.py", a1, 1), ("p", "b.ts", b, 1), ("p", "n.md", "z", 1), ("q", "c.py", "def c(): pass\n", 1),
              ("p", "a.py", "x = 0\n", 0)],
             [("p", "a.py", a2, 5), ("p", "b.ts", b, 5), ("q", "d.py", "def d(): pass\n", 5)],
             [("p", "a.py", a1, 3), ("q", "c.py", None, 6), ("q", "d.py", "def d(): pass\n", 6), ("q", "e.js", None, 6)]]
    store = TableStore(spark, str(tmp_path / "streamed"))
    opened = []
    for drop in drops:
        spark.createDataFrame(drop, schema).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        index_stream.stream_into_index(source, store, str(tmp_path / "ck"), "arrival")
        opened.append({f: f.stat().st_mtime_ns for f in (tmp_path / "streamed").rglob("*.parquet")})
    batch = TableStore(spark, str(tmp_path / "batch"))
    last = [("p", "a.py", a2), ("p", "b.ts", b), ("q", "d.py", "def d(): pass\n")]
    index_project(batch, spark.createDataFrame(last, "project_id string, file_path string, content string"))
    assert _tables(store) == _tables(batch)
    assert {r.name for r in store.read("symbols").collect()} >= {"Two", "go", "Q", "d"}
    # the last drop deletes c.py: one folder of each table is written anew, the others stay as they are
    changed = {f.parent for f in set(opened[1]) ^ set(opened[2])}
    assert len(changed) == 7 and len({(f.parent.name, f.name) for f in changed}) == 1


def test_rows_of_one_batch_and_state(spark, tmp_path):
    schema = "project_id string, file_path string, content string, arrival int"
    seen = []

    def drain(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        index_stream.stream_index(source, str(tmp_path / "out"), str(tmp_path / "ck"), "arrival",
                                  lambda rows: seen.append(sorted((r.file_path, r.content) for r in rows.collect())))
    drain([("p", "a.py", f"v{i}", i) for i in range(50)] + [("p", "b.py", None, 1), (None, "c.py", "c", 1)])
    assert seen[-1] == [("a.py", "v49"), ("c.py", "c")]
    drain([("p", "a.py", None, 60), ("p", "b.py", "b", 1), ("p", "b.py", "b", 2)])
    assert seen[-1] == [("a.py", None), ("b.py", "b")]
    drain([("p", "a.py", "back", 55), ("p", "b.py", "b", 9)])
    assert seen[-1] == []
    drain([("p", "a.py", "back", 61)])
    assert seen[-1] == [("a.py", "back")]
    got = index_stream.current_files(spark, str(tmp_path / "out")).collect()
    assert {(r.project_id, r.file_path) for r in got} == {("p", "a.py"), ("p", "b.py"), (None, "c.py")}


def _visits(rows, gap):
    """Sessions (key, events, first, last) by sorting: a row within the gap of the one before belongs to it."""
    out = []
    for key in {k for k, _, _ in rows}:
        times = sorted({(i, t) for k, i, t in rows if k == key}, key=lambda x: x[1])
        runs = [[times[0][1]]]
        for _, t in times[1:]:
            runs[-1].append(t) if t - runs[-1][-1] <= gap else runs.append([t])
        out += [(key, len(r), r[0], r[-1]) for r in runs]
    return sorted(out)


def test_sessions_by_gap_with_late_rows(spark, tmp_path):
    schema = "key string, id int, second long"
    counts = []

    def drain(rows):
        frame = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("second"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        counts.append(session_stream.stream_sessions(
            source, str(tmp_path / "out"), str(tmp_path / "ck"), ["key"], "at", ["key", "id"], "100 seconds",
            "1000 seconds", {"ids": "id"}))

    first = [("a", 1, 5000), ("a", 2, 5099), ("a", 3, 5199), ("a", 4, 5400), ("b", 5, 5000), (None, 6, 5000)]
    late = [("a", 7, 5299), ("b", 5, 5000), ("b", 8, 4950), ("a", 1, 5000)]  # 7 joins two sessions; two are repeats
    drain(first)
    drain(late)
    drain([("z", 9, 9000)])
    drain([("a", 10, 5100), ("z", 11, 9050)])  # 10 is later than the watermark
    drain([("z", 12, 20_000)])
    drain([("z", 13, 30_000)])
    assert sum(c["too_late"] for c in counts) == 1 and counts[3]["too_late"] == 1
    want = _visits(sorted({r for r in first + late if r[0]}), 100) + [("z", 2, 9000, 9050), ("z", 1, 20_000, 20_000)]
    got = spark.read.parquet(str(tmp_path / "out")).select(
        "key", "events", F.unix_timestamp("first_at"), F.unix_timestamp("last_at"), "ids").collect()
    assert sorted(tuple(r)[:4] for r in got if r.key) == sorted(want)
    assert [tuple(r)[1:] for r in got if r.key is None] == [(1, 5000, 5000, 6)]
    assert {r.ids for r in got if r.key == "a"} == {13, 4}


def test_state_of_sessions_and_rollup_stays_small(spark, tmp_path):
    sizes = {"sessions": [], "rollup": []}
    for day in range(8):
        rows = spark.range(40).select(
            (F.col("id") % 5).cast("string").alias("session_id"), F.lit("p").alias("project_id"), F.lit("user").alias("role"),
            F.lit(1).alias("token_count"), (F.col("id") + 100 * day).alias("turn"),
            F.timestamp_seconds(F.lit(86_400 * 3 * day) + F.col("id")).alias("at"))
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        for name, run in (("sessions", lambda s: session_stream.stream_sessions(
                s, str(tmp_path / "s"), str(tmp_path / "ck-s"), ["session_id"], "at", ["turn"])),
                ("rollup", lambda s: session_stream.stream_session_rollup(
                    s, str(tmp_path / "r"), str(tmp_path / "ck-r"), ["session_id", "turn"], "at"))):
            sizes[name].append(max(run(source)["state_rows"][-1:], default=0))
    assert max(sizes["sessions"][2:]) <= max(sizes["sessions"][:2]) and max(sizes["rollup"][2:]) <= max(sizes["rollup"][:2])
    total = session_stream.current_rollup(spark, str(tmp_path / "r")).agg(F.sum("message_count")).first()[0]
    assert total == 8 * 40
    # compaction: one row per session, the same sums, also when run again or with more batches
    assert session_stream.compact_rollup(spark, str(tmp_path / "r")) == session_stream.compact_rollup(spark, str(tmp_path / "r"))
    assert session_stream._parts(spark, str(tmp_path / "r")).count() == 5
    assert session_stream.current_rollup(spark, str(tmp_path / "r")).agg(F.sum("message_count")).first()[0] == total
    assert len([p for p in (tmp_path / "r").iterdir() if p.name.startswith("batch_id")]) == 1


def test_todo_defaults(spark):
    base = spark.createDataFrame([("1", "a", "done", "high")],
                                 "todo_id string, title string, status string, priority string")
    changes = spark.createDataFrame([("1", None, None), ("2", "b", None)],
                                    "todo_id string, title string, status string")
    got = sorted(K.upsert_todos(base, changes).collect())
    assert got == [("1", "a", "done", "high"), ("2", "b", "open", "medium")]


def test_newest_of_a_group_is_told_without_building_frames(monkeypatch):
    import pandas as pd

    class State:
        def __init__(self, known=None):
            self.exists, self.get, self.new = known is not None, known, None

        def update(self, value):
            self.new = value

    def frame(*rows):
        return pd.DataFrame([("p", "f", *r) for r in rows], columns=index_stream.CHANGED)

    frames = [frame(("a", "1", 2), ("b", "2", 2), ("c", "0", 1)), frame((None, "", 2))]
    monkeypatch.setattr(index_stream.pd, "DataFrame", None)  # one of these for each file was most of the time
    for known, new, want in ((None, (2, "2"), ["b"]), ((1, "2"), (2, "2"), []), ((2, "9"), None, []), ((1, "9"), (2, "2"), ["b"])):
        state = State(known)
        got = [v for f in index_stream._newest(("p", "f"), iter(frames), state) for v in f["content"]]
        assert (got, state.new) == (want, new)


def test_files_of_a_bucket_are_told_apart_in_few_groups(spark, tmp_path):
    """A bucket of many files gives what a group for each file gives; its state is one entry."""
    schema = "project_id string, file_path string, content string, arrival int"
    keys = [("p", "a.py"), (None, "a.py"), ("pa", ".py"), *[("p", f"m{i}.py") for i in range(60)]]
    drops = [[(*k, f"{i % 7}{v}", v) for i, k in enumerate(keys) for v in range(i % 3 + 1)],
             [(*k, None if i % 4 == 0 else "late" if i % 4 == 1 else f"{i % 7}0", 0 if i % 4 == 1 else 2 + i % 2)
              for i, k in enumerate(keys)],
             [(*k, "back", 2 + i % 5) for i, k in enumerate(keys)]]
    seen, entries = {}, {}
    for buckets in (None, 3):
        got, at = [], tmp_path / str(buckets)
        for drop in drops:
            spark.createDataFrame(drop, schema).write.mode("append").parquet(str(at / "in"))
            changed = index_stream.changed_files(spark.readStream.schema(schema).parquet(str(at / "in")), "arrival", buckets)
            query = (changed.writeStream.outputMode("update").option("checkpointLocation", str(at / "ck")).trigger(availableNow=True)
                     .foreachBatch(lambda rows, _, got=got: got.append(sorted(map(str, rows.collect())))).start())
            query.awaitTermination()
        seen[buckets], entries[buckets] = got, query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert seen[3] == seen[None] and all(seen[3]) and entries == {None: len(keys), 3: 3}
