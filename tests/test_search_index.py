import pytest

from codelake.operators import documents as D
from codelake.operators import search_index as SI
from codelake.sources.tables import TableStore

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def texts(n):
    return {f"d{i}.md": " ".join(WORDS[(i * k) % 10] for k in range(1, 8)) for i in range(n)}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [("p", f, t) for f, t in texts(2000).items()]
    rows += [("p", "e.md", ""), ("p", "é.md", "Déjà VU needle"), ("p", "long.md", "x" * 300_000 + "needle"),
             ("q", "e.md", "another needle")]
    out = TableStore(spark, str(tmp_path_factory.mktemp("search")))
    D.store_documents(out, spark.createDataFrame(rows, "project_id string, file_path string, content string"))
    SI.index_texts(out)
    return out


def found(df):
    return [(r.file_path, r.hits) for r in df.collect()]


@pytest.mark.parametrize("query", ["needle", "Alpha beta", "déjà vu", "ta", "x", "no such text", "iota"])
def test_same_rows_as_the_scan(store, query):
    docs = store.read("documents")
    assert found(SI.search_by_index(store, "p", query)) == found(D.search_documents(docs, "p", query))


def test_only_candidates_are_read(store):
    some = {r.file_path for r in SI.candidates(store, "p", "needle").collect()}
    assert {"é.md", "long.md"} <= some and len(some) < 20
    plan = SI.search_by_index(store, "p", "needle")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(file_path" in plan
    assert found(SI.search_by_index(store, "nobody", "needle")) == []


def test_changed_documents_only(store, spark):
    def folders():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
            SI._path(store)).where("path LIKE '%.parquet'").select("path").collect()
        return {r.path for r in files}

    before = folders()
    new = spark.createDataFrame([("p", "d7.md", "now with a needle"), ("p", "é.md", "without")],
                                "project_id string, file_path string, content string")
    D.store_documents(store, new)
    SI.index_texts(store, new)
    assert len(before & folders()) >= len(before) - 2 and before != folders()
    assert found(SI.search_by_index(store, "p", "needle")) == [("d7.md", 1), ("long.md", 1)]
    store.bucketed("documents").delete_where({"project_id": "q"})
    SI.index_texts(store, spark.createDataFrame([("q", "e.md")], "project_id string, file_path string"))
    assert found(SI.search_by_index(store, "q", "needle")) == []


def test_without_documents(spark, tmp_path):
    empty = TableStore(spark, str(tmp_path / "none"))
    SI.index_texts(empty)
    assert found(SI.search_by_index(empty, "p", "needle")) == []
