import random

import pytest
from pyspark.sql import functions as F

from codelake.plans.index import ENTITIES, index_project
from codelake.plans.nesting import innermost_scope, nest
from codelake.sources import scan as I
from codelake.sources.tables import TableStore


def test_scan_real_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PY").write_text("é = 1\n")
    (tmp_path / "a" / "y.txt").write_text("no")
    (tmp_path / "top.ts").write_text("let a")
    rows = {r.file_path.rsplit("/", 1)[1]: r for r in I.scan_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"x.PY", "top.ts"}
    assert rows["x.PY"].content == "é = 1\n" and rows["x.PY"].byte_size == 7
    flat = I.scan_files(spark, str(tmp_path), recursive=False)
    assert [r.file_path.rsplit("/", 1)[1] for r in flat.collect()] == ["top.ts"]
    assert I.scan_files(spark, str(tmp_path), patterns=["a/*.PY"]).count() == 1


def test_index_skips_unchanged_and_replaces_changed(spark, files, tmp_path):
    store = TableStore(spark, str(tmp_path))
    first = files({"a.py": "def one(): pass\n", "b.js": "function two() {}\n", "c.md": "x"})
    first = first.drop("language")

    def status(scan, second):
        when = F.timestamp_seconds(F.lit(second))
        return {r.file_path: r.status for r in index_project(store, scan, indexed_at=when).collect()}

    assert status(first, 1) == {"a.py": "new", "b.js": "new", "c.md": "unsupported_language"}
    again = status(first, 2)
    assert again == {"a.py": "unchanged", "b.js": "unchanged", "c.md": "unsupported_language"}
    second = first.where("file_path != 'b.js'").withColumn(
        "content", F.regexp_replace("content", "one", "uno"))
    assert status(second, 3) == {"a.py": "changed", "b.js": "file_not_found",
                                 "c.md": "unsupported_language"}
    assert {r.name for r in store.read("symbols").collect()} == {"uno"}
    assert all(store.exists(e) for e in ENTITIES)
    assert {r.file_path for r in store.read("files").collect()} == {"a.py"}
    assert status(first.where("false"), 4) == {}


def test_scan_of_real_files_into_the_index(spark, tmp_path):
    """The documented chain, twice: bad bytes, an empty file, one too large, an edit and a removal."""
    root, store = tmp_path / "src", TableStore(spark, str(tmp_path / "tables"))
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "__init__.py").write_text("")
    (root / "pkg" / "_inner.py").write_text("def inner(): pass\n")
    (root / "pkg" / "latin.py").write_bytes(b"# caf\xe9\ndef served():\n    pass\n")
    (root / "pkg" / "one.py").write_text("def one():\n    pass\n")
    (root / "gone.js").write_text("function gone() {}\n")
    (root / "big.py").write_text("x = 1\n" * 5000)

    def run(second):
        scan = I.scan_files(spark, str(root), listing=I.skipped_files(spark, str(root)), max_bytes=20_000)
        out = index_project(store, scan.withColumn("project_id", F.lit("p")),
                            indexed_at=F.timestamp_seconds(F.lit(second)))
        return {r.file_path.split("/src/")[1]: r.status for r in out.collect()}

    assert run(1) == {"pkg/__init__.py": "new", "pkg/_inner.py": "new", "pkg/latin.py": "new",
                      "pkg/one.py": "new", "gone.js": "new", "big.py": "failed"}
    assert {r.name for r in store.read("symbols").collect()} == {"served", "one", "gone", "inner"}
    failed = store.read("files").where("error_message IS NOT NULL").collect()
    assert [r.byte_size for r in failed] == [30_000] and failed[0].content_hash is None
    (root / "gone.js").unlink()
    (root / "pkg" / "one.py").write_text("def uno():\n    pass\n")
    (root / "big.py").write_text("def small(): pass\n")
    assert run(2) == {"pkg/__init__.py": "unchanged", "pkg/_inner.py": "unchanged", "pkg/latin.py": "unchanged",
                      "pkg/one.py": "changed", "gone.js": "file_not_found", "big.py": "changed"}
    assert {r.name for r in store.read("symbols").collect()} == {"served", "uno", "small", "inner"}
    assert set(run(3).values()) == {"unchanged"}


@pytest.fixture
def spans(spark):
    """Random properly nested spans of two files, with the truth by brute force."""
    rnd, rows = random.Random(3), []

    def grow(path, low, high, depth):
        while low + 2 < high and depth < 6:
            a = rnd.randrange(low, high)
            b = rnd.randrange(a, min(a + 40, high))
            rows.append((path, a, b, f"{path}{a}-{b}"))
            grow(path, a + 1, b, depth + 1)
            low = b + 1
    for path in ("f", "g"):
        grow(path, 1, 300, 0)
    return spark.createDataFrame([("p", *r) for r in rows],
                                 "project_id string, file_path string, a int, b int, name string")


def test_nesting_against_brute_force(spans):
    rows = spans.collect()
    got = {r.name: (r.depth, [c.name for c in r.chain]) for r in nest(spans, "a", "b", ["name"]
                                                                     ).collect()}
    assert len(got) == len(rows)
    for r in rows:
        outer = sorted((o for o in rows if o.file_path == r.file_path and o.name != r.name
                        and o.a <= r.a and r.b <= o.b), key=lambda o: o.a)
        assert got[r.name] == (len(outer) + 1, [o.name for o in outer])


def test_innermost_scope_against_brute_force(spark, spans):
    scopes = nest(spans, "a", "b", ["name"]).select(
        "project_id", "file_path", F.col("name").alias("scope_id"), F.col("a").alias("start_line"),
        F.col("b").alias("end_line"), "depth")
    lines = spark.range(0, 320).select(
        F.lit("p").alias("project_id"), F.explode(F.array(F.lit("f"), F.lit("g"), F.lit("none")))
        .alias("file_path"), F.col("id").cast("int").alias("line"))
    rows = scopes.collect()
    got = innermost_scope(lines, "line", scopes).collect()
    assert len(got) == 960
    for r in got:
        holding = [s for s in rows if s.file_path == r.file_path
                   and s.start_line <= r.line <= s.end_line]
        best = max(holding, key=lambda s: s.depth).scope_id if holding else None
        assert r.scope_id == best


def test_numbered_files_get_their_keys_back(spark):
    """A null is told apart from other keys, repeated files count once, and neither side is shuffled again."""
    from codelake.plans.index import Extraction
    from codelake.plans.lines import named

    keys = [("p", "a.py"), ("p", None), (None, "p"), ("", "p"), ("pa", ".py"), ("p", "b.py"), ("p", "b.py")]
    files = spark.createDataFrame([(*k, "python", "def f(): pass\n") for k in keys],
                                  "project_id string, file_path string, language string, content string")
    work = Extraction(files)
    assert [f.dataType.simpleString() for f in work.python_lines.schema[:2]] == ["bigint", "bigint"]
    back = named(work.python_lines, work.python_keys)
    assert {(r.project_id, r.file_path) for r in back.collect()} == set(keys)
    assert back.where("line_no = 1 AND project_id = 'p' AND file_path = 'b.py'").count() == 2
    assert work.python_keys.count() == len(set(keys))
    assert {(r.project_id, r.file_path) for r in work.python("symbols").collect()} == set(keys)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 2


def test_no_extracted_rows_are_broadcast(spark):
    """Estimates make computed rows small whatever the corpus: joined with the keys of their files, neither side moves."""
    from codelake.plans.index import Extraction

    path, text = F.when(F.col("id") == 0, "a.py").otherwise("b.ts"), F.lit("import os\nfunction f() {}\n")
    work = Extraction(spark.range(2).select(F.lit("p").alias("project_id"), path.alias("file_path"), text.alias("content")))
    for family in (work.python, work.script):
        for entity in ENTITIES:
            assert "Broadcast" not in family(entity)._jdf.queryExecution().sparkPlan().toString()


def test_tokens_are_passed_over_few_times(spark, files):
    """One pass of windows over the lines, then as few as the rules allow over the tokens, which are many."""
    from codelake.plans.index import Extraction

    work = Extraction(files({"a.py": "def f(): pass\n", "b.ts": "function f() {}\n"}))
    passes = [df._jdf.queryExecution().optimizedPlan().toString().count("Window [")
              for df in (work.python("references"), work.script_tokens, work.definitions)]
    assert passes == [3, 3, 5]


def test_decorators_and_ends_of_definitions(files):
    """Rows deeper than any definition are left out early; decorators and ends stay right."""
    from codelake.plans.index import Extraction

    text = ("@one\nclass A:\n    x = 1\n    if x:\n        @two(\n            3)\n        @four\n        def f(self):\n            return 5\n"
            "    y = 6\n@lost\nz = 7\ndef g():\n        return 8\n")
    rows = Extraction(files({"a.py": text})).table("symbols").collect()
    assert {r.name: (r.qualified_name, list(r.decorators), r.start_line, r.end_line) for r in rows} == {
        "A": ("A", ["@one"], 2, 10), "f": ("A.f", ["@two(\n            3)", "@four"], 8, 9), "g": ("g", [], 13, 14)}
