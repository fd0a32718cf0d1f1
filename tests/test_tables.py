import pytest
from pyspark.sql import functions as F

from codelake.sources import tables as T


@pytest.fixture
def store(spark, tmp_path):
    return T.TableStore(spark, str(tmp_path))


def users(spark):
    return spark.createDataFrame([(1, "ann", 2.5, True), (2, "bob", None, False),
                                  (3, None, 1.0, True)],
                                 "id long, name string, score double, active boolean")


def test_append_creates_aligns_and_counts(spark, store):
    assert store.append("users", users(spark)) == 3
    extra = spark.createDataFrame([(4, 9)], "id long, unknown int")
    assert store.append("users", extra) == 1
    rows = store.read("users")
    assert rows.columns == ["id", "name", "score", "active"]
    assert rows.where("id = 4 and name is null").count() == 1


def test_append_of_nothing(spark, store):
    assert store.append("users", users(spark).where("id < 0")) == 0
    assert not store.exists("users")
    store.append("users", users(spark))
    assert store.append("users", users(spark).where("id < 0")) == 0
    assert store.read("users").count() == 3


def test_append_without_create(spark, store):
    with pytest.raises(T.TableMissing):
        store.append("users", users(spark), create=False)


def test_delete_by_equality_keeps_nulls(spark, store):
    store.append("users", users(spark))
    assert store.delete_where("users", {"name": "ann", "active": True}) == 1
    assert store.delete_where("users", {"name": "ann"}) == 0
    assert {r.id for r in store.read("users").collect()} == {2, 3}
    assert store.delete_where("users", delete_all=True) == 2
    assert store.read("users").count() == 0


def test_delete_needs_a_condition_and_a_table(spark, store):
    with pytest.raises(T.TableMissing):
        store.delete_where("users", {"id": 1})
    store.append("users", users(spark))
    with pytest.raises(ValueError):
        store.delete_where("users")


def test_partitioned_delete_touches_only_matching_partitions(spark, store):
    rows = spark.range(100).select("id", (F.col("id") % 4).cast("string").alias("part"))
    store.append("t", rows, partition_by=["part"])
    reader = store.read("t")
    assert store.delete_where("t", {"id": 0}) == 1
    assert store.delete_where("t", {"part": "2"}) == 25
    left = store.read("t")
    assert left.count() == 74 and left.where("part = '2'").count() == 0
    # Who reads the old snapshot still sees all of it.
    assert reader.count() == 100


def test_schema_of_records(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 2.5}',), (None,)], "j string")
    found = {r.key: (r.type, r.row_count) for r in T.infer_schema(rows, "j").collect()}
    assert found["a"][0].startswith("DECIMAL") and found["a"][1] == 2
    assert found["b"] == ("STRING", 1) and len(found) == 2


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_export_and_import(spark, tmp_path, fmt):
    rows = users(spark).where("name is not null").withColumn(
        "name", F.concat("name", F.lit(', "quoted"')))
    T.export_rows(rows, str(tmp_path / "out"), fmt)
    back = T.import_rows(spark, str(tmp_path / "out"), fmt, rows.schema)
    assert sorted(back.collect()) == sorted(rows.collect())


def test_page_and_views(spark, store):
    store.append("users", users(spark))
    assert [r.id for r in T.read_rows(store.read("users"), ["id"], 1, 1).collect()] == [2]
    assert store.sql("SELECT max(id) AS m FROM users").first().m == 3


def test_stats_leave_metadata_out(spark, store):
    store.append("users", users(spark))
    store.append("metadata", users(spark))
    rows = T.table_stats({n: store.read(n) for n in ("users", "metadata")}).collect()
    assert [(r.table_name, r.row_count, r.column_count) for r in rows] == [("users", 3, 4)]
    assert rows[0].byte_size > 0


def test_delete_and_read_keep_odd_partition_values(spark, tmp_path):
    from codelake.sources.tables import TableStore
    store = TableStore(spark, str(tmp_path))
    rows = [(1, "007", "x"), (2, None, "gone"), (3, "b:c", "gone"), (4, "b:c", "x"), (5, "a/b=c %", "gone"), (6, "1", "x")]
    assert store.append("t", spark.createDataFrame(rows, "id int, p string, v string"), partition_by=["p"]) == 6
    assert store.delete_where("t", {"v": "gone"}) == 3
    assert sorted(map(tuple, store.read("t").select("id", "p", "v").collect())) == [r for r in rows if r[2] != "gone"]
    more = spark.createDataFrame([(7, "08")], "id int, p string")
    assert store.append("t", more) == 1
    assert {r.p for r in store.read("t").collect()} == {"007", "b:c", "1", "08"}


def test_csv_comes_back_as_it_was(spark, tmp_path):
    from codelake.sources import tables as T
    rows = [(1, "a\nb"), (2, ""), (3, None), (4, 'say "x", \\N or \\\\'), (5, "tab\tand,comma"), (6, " edge ")]
    df = spark.createDataFrame(rows, "id int, text string")
    T.export_rows(df, str(tmp_path / "c"), "csv")
    assert sorted(map(tuple, T.import_rows(spark, str(tmp_path / "c"), "csv", df.schema).collect())) == rows


def test_one_type_for_each_key_and_broken_records(spark):
    from codelake.sources import tables as T
    texts = ['{"a": 1, "b": "x"}', '{"a": 2.5}', '{"a": null, "c": [1]}', "{broken", None]
    got = {r.key: (r.type, r.row_count) for r in
           T.infer_schema(spark.createDataFrame([(t,) for t in texts], "j string"), "j").collect()}
    assert got[None] == ("MALFORMED", 1) and got["b"] == ("STRING", 1) and got["c"][1] == 1
    assert got["a"][0].startswith("DECIMAL") and got["a"][1] == 3


def _files(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_buckets_of_other_files_are_not_rewritten(spark, tmp_path):
    from codelake.sources.buckets import BucketTable
    schema = spark.createDataFrame([], "project_id string, file_path string, name string, line int").schema
    table = BucketTable(spark, str(tmp_path / "t"), schema, ["project_id", "file_path", "line"], 4, 8)
    rows = spark.range(400).select(
        F.concat(F.lit("0"), (F.col("id") % 4).cast("string")).alias("project_id"), F.concat(F.lit("f"), F.floor(F.col("id") / 4)).alias("file_path"),
        F.concat(F.lit("n"), F.col("id") % 7).alias("name"), F.col("id").cast("int").alias("line"))
    assert table.read().count() == 0
    table.append(rows)
    assert sorted(table.read().collect()) == sorted(rows.collect())
    before = _files(tmp_path)
    new = spark.createDataFrame([("01", "f5", "new", 1), ("01", "f5", "newer", 2)], schema)
    table.replace_files(new, new.select("project_id", "file_path"))
    after = _files(tmp_path)
    same = [f for f in before if after.get(f) == before[f]]
    assert len(before) - len(same) == 1 and len(after) == len(before)
    assert table.read("01", "f5").count() == 2 and table.read().count() == 401
    assert table.read("01", "f5").inputFiles() and table.read("01").count() == 101
    with pytest.raises(Exception, match="not among the changed"):
        table.replace_files(rows, new.select("project_id", "file_path"))
    assert table.read().count() == 401
    # a delete by equality: only the buckets that hold a match
    before = after
    assert table.delete_where({"name": "newer"}) == 1
    after = _files(tmp_path)
    assert len([f for f in before if after.get(f) == before[f]]) == len(before) - 1
    # a bucket without rows left, a project, everything
    assert table.delete_where({"project_id": "01", "file_path": "f5"}) == 1
    assert table.delete_where({"project_id": "02"}) == 100
    assert table.read("02").count() == 0 and table.read().count() == 299
    assert table.delete_where({"name": "none"}) == 0
    assert table.delete_where({}) == 299 and table.read().count() == 0


def test_buckets_of_odd_names(spark, tmp_path):
    from codelake.sources.buckets import BucketTable
    schema = spark.createDataFrame([], "project_id string, file_path string, name string").schema
    table = BucketTable(spark, str(tmp_path / "t"), schema, projects=2, buckets=1)
    rows = [(p, f"{p}.py", "x") for p in ("1", "01", "a/b=c %", "", "__HIVE_DEFAULT_PARTITION__x", "é")] + [(None, "n.py", "x"), (None, "o.py", "x"), ("", "o.py", "z")]
    table.append(spark.createDataFrame(rows, schema))
    assert sorted(map(str, table.read().collect())) == sorted(map(str, spark.createDataFrame(rows, schema).collect()))
    changed = spark.createDataFrame([(None, "n.py"), ("01", "01.py"), ("", ".py")], "project_id string, file_path string")
    table.replace_files(spark.createDataFrame([("01", "01.py", "y")], schema), changed)
    left = {(r.project_id, r.name) for r in table.read().collect()}
    assert left == {("1", "x"), ("01", "y"), ("a/b=c %", "x"), ("__HIVE_DEFAULT_PARTITION__x", "x"), ("é", "x"), (None, "x"),
                    ("", "z")}
    assert table.read("").count() == 1 and table.delete_where({"project_id": ""}) == 1 and table.read("").count() == 0


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_rows_and_rejects_are_all_records(spark, tmp_path, fmt):
    from codelake.sources import tables as T
    (tmp_path / "in").mkdir()
    if fmt == "csv":
        text = 'id,name,score\n1,ann,2.5\nx,bob,1\n3,"two\nlines",4\n4,eve,high\n5,,\n'
    else:
        text = ('{"id": 1, "name": "ann", "score": 2.5}\n{"id": "x", "name": "bob", "score": 1}\n{broken\n'
                '{"id": 3, "name": "two", "score": 4}\n{"id": 5}\n')
    (tmp_path / "in" / f"a.{fmt}").write_text(text)
    schema = spark.createDataFrame([], "id long, name string, score double").schema
    rows, rejects = T.import_checked(spark, str(tmp_path / "in"), fmt, schema)
    assert sorted(r.id for r in rows.collect()) == [1, 3, 5] and rows.count() == 3
    assert rows.select("name").count() == 3  # also when few columns are asked for
    found = rejects.collect()
    assert len(found) == 2 and rejects.count() == 2 and all(r.file_path.endswith(f"a.{fmt}") for r in found)
    assert any("x" in r.record for r in found)


def test_documents_are_stored_once(spark, tmp_path):
    from codelake.operators import documents as D
    store = T.TableStore(spark, str(tmp_path))

    def run(rows):
        files = spark.createDataFrame(rows, "project_id string, file_path string, content string")
        return {r.metric.removeprefix("files_"): r.value for r in D.store_documents(store, files).collect()}

    first = [("p", "README.md", "# One\ntwo words"), ("p", "docs/guide.md", "# G\nx"), ("p", "a.py", "no"), ("q", "README", None)]
    assert run(first) == {"indexed": 2, "skipped": 0, "failed": 1, "total_words": 7}
    before = _files(tmp_path)
    assert run(first) == {"indexed": 0, "skipped": 2, "failed": 1, "total_words": 0}
    assert _files(tmp_path) == before
    assert run([("p", "README.md", "# One\nthree more words"), ("p", "docs/guide.md", None)])["indexed"] == 1
    rows = {r.file_path: r.word_count for r in store.read("documents").collect()}
    assert rows == {"README.md": 5, "docs/guide.md": 3}


def test_many_partition_folders_get_one_file_each(spark, tmp_path):
    rows = spark.range(0, 400, 1, 6).select(F.col("id"), (F.col("id") % 40).alias("part"))
    store = T.TableStore(spark, str(tmp_path))
    store.append("t", rows, partition_by=["part"])
    files = [f for f in (tmp_path / "t").rglob("*.parquet") if f.is_file()]
    assert len(files) == 40
    assert store.delete_where("t", {"part": 7}) == 10
    assert sorted(r.id for r in store.read("t").collect()) == [i for i in range(400) if i % 40 != 7]


def test_ids_are_stored_as_they_are_in_half_the_bytes(spark, tmp_path):
    """Digests are shuffled as bytes; other ids, among them some that look alike, come back unchanged."""
    from codelake.sources.buckets import BucketTable

    hexes = F.sha2(F.col("id").cast("string"), 256)
    odd = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.upper(hexes), F.concat(hexes, F.lit("\n")), F.lit("ab"), F.lit("ü" * 64),
                                 F.lit("g" * 64), F.lit("é" * 32)), (F.col("id") % 8 + 1).cast("int"))
    rows = spark.range(20_000).select(F.lit("p").alias("project_id"), F.concat(F.lit("f"), F.col("id") % 7).alias("file_path"),
                                      hexes.alias("row_id"), F.when(F.col("id") % 2 == 0, hexes).otherwise(odd).alias("other_id"))
    table = BucketTable(spark, str(tmp_path / "t"), rows.schema)
    table.append(rows)
    assert table.read().exceptAll(rows).count() == 0 and rows.exceptAll(table.read()).count() == 0
    size = sum(f.stat().st_size for f in (tmp_path / "t").rglob("*.parquet"))
    assert size < 20_000 * 64  # a digest is 64 characters; there are 30,000 and some odd ids
