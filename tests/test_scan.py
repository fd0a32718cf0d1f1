"""Files of given names, written and scanned back."""

import hashlib
import os

from pyspark.sql import functions as F

from codelake.plans import edge_queries
from codelake.session import new_folder
from codelake.sources import scan


def _folders(root: str) -> int:
    return sum(len(names) for _, names, _ in os.walk(root))


def test_texts_of_one_path_are_one_file_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.txt", 2, "é\n"), ("a/x.txt", 1, "one"), ("a/y.txt", 1, None), ("b/x.txt", 1, "")],
                                 "file_path string, n int, text string")
    for _ in range(2):  # a run again leaves the same
        assert scan.write_texts(rows, str(tmp_path), ["n"]) == 3
    files = {r.file_path.split(f"{tmp_path}/")[1]: r.content
             for r in scan.scan_files(spark, str(tmp_path), extensions=[".txt"]).collect()}
    assert files == {"a/x.txt": "one\né\n\n", "a/y.txt": "\n", "b/x.txt": "\n"}
    assert sorted(n for _, _, names in os.walk(tmp_path) for n in names) == ["x.txt", "x.txt", "y.txt"]
    assert scan.write_texts(rows.where("false"), str(tmp_path / "none"), ["n"]) == 0
    assert scan.scan_files(spark, str(tmp_path / "none")).count() == 0


def test_scanned_contents_make_a_folder_for_each_source_only(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i}", ("a", "b/c d=%", None, "")[i % 4]) for i in range(400)] + [(None, "x", "a"), (7, None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    monkeypatch.setattr(edge_queries, "new_folder", lambda s, label: made.append(new_folder(s, label)) or made[-1])
    got = {r.name: (r.content_hash, r.byte_size, r.line_count) for r in edge_queries.i1_scan_contents(spark, str(tmp_path)).collect()}
    none, want = "__HIVE_DEFAULT_PARTITION__", {}
    for i, text, source in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        name = f"{(source or none).replace('%', '%25').replace('/', '%2F').replace('=', '%3D')}/{none if i is None else i // 50}"
        want[name] = want.get(name, "") + (text or "") + "\n"
    assert {k: v for k, v in got.items() if k != "a/0"} == {
        k: (hashlib.sha256(t.encode()).hexdigest(), len(t.encode()), t.count("\n") + 1)
        for k, t in want.items() if k != "a/0"}  # doc_id 7 without a text has no fixed place among its equals
    assert got["a/0"][1] == len(want["a/0"].encode())
    assert _folders(made[0]) == 3


def test_odd_characters_are_named_as_spark_names_folders(spark, tmp_path):
    odd = [chr(i) for i in range(1, 256)] + ["", None, "a b", "é/ü", "x:y=z%", "😀?"]
    rows = spark.createDataFrame([(s, "t") for s in odd], "source string, text string")
    rows.coalesce(1).write.partitionBy("source").text(str(tmp_path / "t"))
    spark_names = {n.removeprefix("source=") for n in os.listdir(tmp_path / "t") if n.startswith("source=")}
    assert spark_names == {r.n for r in rows.select(edge_queries._folder_name("source").alias("n")).collect()}
