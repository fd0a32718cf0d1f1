"""One query per operator over the given tables, or over data Spark derives from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake import feeds
from codelake.operators import code_queries as C
from codelake.operators import documents as D
from codelake.operators import graph as G
from codelake.operators import search_index as SI
from codelake.operators import sessions as S
from codelake.operators import todos as K
from codelake.operators import versions as V
from codelake.plans.index import ENTITIES, Extraction, index_project
from codelake.session import new_folder
from codelake.sources import scan as I
from codelake.sources import tables as T
from codelake.streaming import index_stream, session_stream

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def at(seconds: int = 1704067200):
    return F.timestamp_seconds(F.lit(seconds))



def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def joined(df: DataFrame, *names: str) -> DataFrame:
    """Arrays as text, so results compare by value."""
    return df.withColumns({n: F.array_join(n, "|") for n in names})


def corpus(spark, sf) -> DataFrame:
    return I.detect_language(feeds.corpus(load(spark, sf, "part")))


def extraction(spark, sf) -> Extraction:
    return Extraction(corpus(spark, sf))


_STORES: dict[tuple[str, str], T.TableStore] = {}


def index(spark, sf) -> T.TableStore:
    """The stored index of the corpus: built by the first query that needs it, then read."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        store = T.TableStore(spark, new_folder(spark, "index"))
        index_project(store, feeds.corpus(load(spark, sf, "part")), indexed_at=at())
        _STORES[key] = store
    return _STORES[key]


def document_rows(spark, sf) -> DataFrame:
    """Two versions of every document, the older one with an empty title line added."""
    files = D.select_documents(feeds.document_files(load(spark, sf, "documents")))
    new = D.index_documents(files, at())
    old = D.index_documents(files.withColumn("content", F.concat(F.lit("# Old\n"), "content")),
                            F.timestamp_seconds(F.lit(1600000000)))
    return new.unionByName(old)


# --- tables -----------------------------------------------------------------------------------

def _events(df: DataFrame) -> DataFrame:
    return df.select("event_id", "user_id", "event_type", "value", "props",
                     F.col("ts").cast("string").alias("ts"))


@query
def t1_append(spark, sf):
    events = load(spark, sf, "events")
    store = T.TableStore(spark, new_folder(spark, "t1"))
    store.append("events", events.where("event_id % 2 = 0"), sort_by=["event_id"])
    extra = events.where("event_id % 2 = 1").drop("props").withColumn("more", F.lit(1))
    store.append("events", extra)
    return _events(store.read("events"))


@query
def t2_infer_schema(spark, sf):
    return T.infer_schema(load(spark, sf, "events"), "props")


@query
def t3_delete_where(spark, sf):
    store = T.TableStore(spark, new_folder(spark, "t3"))
    store.append("orders", load(spark, sf, "orders"), partition_by=["o_orderpriority"])
    removed = store.delete_where("orders", {"o_orderstatus": "F"})
    return store.read("orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.col("o_orderpriority").cast("string"), F.lit(removed).cast("bigint").alias("removed"))


@query
def t4_sql(spark, sf):
    return spark.sql("SELECT event_type, count(*) AS n, max(value) AS top FROM {events} "
                     "WHERE value > 5 GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3",
                     events=load(spark, sf, "events"))


@query
def t5_export_import(spark, sf):
    customer = load(spark, sf, "customer")
    path = new_folder(spark, "t5")
    T.export_rows(customer, path, "csv")
    return T.import_rows(spark, path, "csv", customer.schema)


@query
def t4_store_sql(spark, sf):
    """Free SQL over stored tables: a plain one, and the symbols in their buckets."""
    store = T.TableStore(spark, new_folder(spark, "t4"))
    store.append("pieces", load(spark, sf, "part"))
    store.bucketed("symbols").append(index(spark, sf).read("symbols"))
    return store.sql("SELECT s.kind, count(*) AS n, count(DISTINCT p.p_brand) AS brands FROM symbols s JOIN pieces p "
                     "ON p.p_partkey = CAST(regexp_extract(s.file_path, 'm([0-9]+)', 1) AS BIGINT) GROUP BY s.kind")


@query
def t5_json_and_parquet(spark, sf):
    customer = load(spark, sf, "customer")
    path = new_folder(spark, "t5f")
    for fmt in ("json", "parquet"):
        T.export_rows(customer, f"{path}/{fmt}", fmt)
    return reduce(DataFrame.unionByName, [
        T.import_rows(spark, f"{path}/{fmt}", fmt, customer.schema).withColumn("format", F.lit(fmt))
        for fmt in ("json", "parquet")])


@query
def t5_rejects(spark, sf):
    """Rows and rejects of files in which every tenth key is no number."""
    path, key = new_folder(spark, "t5r"), F.col("c_custkey")
    shown = F.when(key % 10 == 3, F.concat(F.lit("x"), key)).otherwise(key.cast("string"))
    customer = load(spark, sf, "customer").select(shown.alias("k"), "c_name")
    customer.select(F.concat(F.lit('{"k": '), "k", F.lit(', "c_name": "'), "c_name", F.lit('"}'))).write.text(f"{path}/json")
    schema = customer.withColumn("k", F.lit(0).cast("bigint")).schema
    rows, bad = T.import_checked(spark, f"{path}/json", "json", schema)
    none = F.lit(None).cast("bigint")
    out = rows.select(F.lit("row").alias("kind"), "k", F.col("c_name").alias("text"))
    return out.unionByName(bad.select(F.lit("reject").alias("kind"), none.alias("k"), F.col("record").alias("text")))


@query
def t6_read_table(spark, sf):
    page = T.read_rows(load(spark, sf, "events"), ["ts", "event_id"], limit=500, offset=20,
                       since="2024-01-03 00:00:00", time_column="ts")
    return _events(page)


@query
def t7_table_stats(spark, sf):
    stats = T.table_stats({t: load(spark, sf, t) for t in TABLES})
    return stats.drop("byte_size")


@query
def t7_table_bytes(spark, sf):
    return T.table_stats({t: load(spark, sf, t) for t in TABLES}).select("table_name", "byte_size")


# --- versions ---------------------------------------------------------------------------------

@query
def v1_latest_by_key(spark, sf):
    return _events(V.latest_by_key(load(spark, sf, "events"), ["user_id"], "ts", ["event_id"]))


@query
def v2_apply_changes(spark, sf):
    base = load(spark, sf, "customer")
    known = base.where("c_custkey % 10 = 0").select(
        "c_custkey", F.lit(None).cast("string").alias("c_name"),
        (F.col("c_acctbal") + 1).alias("c_acctbal"))
    unknown = base.where("c_custkey % 100 = 7").select(
        (-F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("c_name"),
        F.lit(0.0).alias("c_acctbal"))
    return V.apply_changes(base, known.unionByName(unknown), ["c_custkey"])


@query
def v3_version_history(spark, sf):
    rows = load(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    history = V.version_history(rows, ["user_id"], "ts", "value", ["event_id"])
    return history.select("event_id", "user_id", "value", "version_no", "previous_value")


@query
def v4_cascade_delete(spark, sf):
    customer, orders = load(spark, sf, "customer"), load(spark, sf, "orders")
    doomed = customer.where("c_custkey % 10 = 3").select("c_custkey")
    order_keys = orders.join(doomed, orders.o_custkey == doomed.c_custkey, "left_semi").select(
        "o_orderkey")
    _, counts = V.cascade_delete(
        {"customer": (customer, "c_custkey"), "orders": (orders, "o_custkey"),
         "lineitem": (load(spark, sf, "lineitem"), "l_orderkey")},
        {"customer": doomed, "orders": doomed, "lineitem": order_keys})
    return counts


# --- scan and incremental index ---------------------------------------------------------------

@query
def i1_scan_files(spark, sf):
    files = I.scan_files(spark, sf, extensions=[".parquet"])
    return files.select(F.regexp_extract("file_path", r"([^/]*)\.parquet$", 1).alias("name"),
                        (F.col("byte_size") > 0).alias("has_bytes"))


@query
def i2_detect_language(spark, sf):
    pages = load(spark, sf, "pages").select(F.col("url").alias("file_path"))
    both = corpus(spark, sf).select("file_path").unionByName(pages)
    return I.detect_language(both)


@query
def i3_file_facts(spark, sf):
    files = load(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return I.file_facts(files).drop("content")


def _document_scan(spark, sf) -> tuple[DataFrame, DataFrame]:
    files = feeds.document_files(load(spark, sf, "documents"))
    language = F.when(F.col("doc_id") % 9 != 0, "text")
    scan = I.file_facts(feeds.changed_files(files).withColumn("language", language))
    indexed = I.file_facts(files).withColumn("indexed_at", F.lit(2))
    stale = indexed.withColumns({"indexed_at": F.lit(1), "content_hash": F.lit("stale")})
    return scan, indexed.unionByName(stale)


@query
def i4_diff_files(spark, sf):
    return I.diff_files(*_document_scan(spark, sf)).drop("new_hash")


@query
def i5_index_run_stats(spark, sf):
    store = index(spark, sf)
    files = I.file_facts(corpus(spark, sf))
    old = store.read("files").where("line_count % 4 != 0")
    return I.index_run_stats(I.diff_files(files, old), {e: store.read(e) for e in ENTITIES})


@query
def i6_replace_files(spark, sf):
    changed, edited = _edited_files(spark, sf)
    new = Extraction(edited).table("symbols")
    table = I.replace_files(index(spark, sf).read("symbols"), new, changed)
    return longs(table.select(SYMBOL_PLACES), "start_line", "end_line")


def _edited_files(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The keys of every fifteenth part's file, and these files with a function added."""
    changed = load(spark, sf, "part").where("p_partkey % 15 = 0").select(
        F.concat(F.lit("proj-"), F.floor(F.col("p_partkey") / 30).cast("string")).alias("project_id"),
        F.concat(F.lit("src/m"), "p_partkey", F.lit(".py")).alias("file_path"))
    files = corpus(spark, sf).join(changed, I.FILE_KEY, "left_semi")
    return changed, files.withColumn("content", F.concat("content", F.lit("\ndef added():\n    pass\n")))


SYMBOL_PLACES = ["file_path", "name", "kind", "start_line", "end_line"]


@query
def i6_rewrite_buckets(spark, sf):
    """The changed files written into stored buckets, and one project deleted from them."""
    store = T.TableStore(spark, new_folder(spark, "i6"))
    table = store.bucketed("symbols")
    symbols = index(spark, sf).read("symbols")
    table.append(symbols)
    changed, edited = _edited_files(spark, sf)
    table.replace_files(Extraction(edited).table("symbols"), changed)
    store.delete_where("symbols", {"project_id": "proj-2"})
    return longs(store.read("symbols").select(SYMBOL_PLACES), "start_line", "end_line")


@query
def t3_delete_in_buckets(spark, sf):
    """Deletes by equality: of a kind, of a project, of one file."""
    store = T.TableStore(spark, new_folder(spark, "t3b"))
    store.bucketed("symbols").append(index(spark, sf).read("symbols"))
    removed = [store.delete_where("symbols", e) for e in (
        {"kind": "class"}, {"project_id": "proj-2"}, {"project_id": "proj-1", "file_path": "src/m36.py"})]
    return longs(store.read("symbols").select(SYMBOL_PLACES), "start_line", "end_line").withColumn(
        "removed", F.lit(sum(removed)).cast("bigint"))


@query
def i7_stream_entities(spark, sf):
    """Three drops with edits, repeats, late older versions and deletions, kept current in every table."""
    files, folder = corpus(spark, sf).select(*I.FILE_KEY, "content"), new_folder(spark, "i7e")
    edited = _edited_files(spark, sf)[1].select(*I.FILE_KEY, "content")
    key = F.regexp_extract("file_path", r"m(\d+)", 1).cast("int")
    old = files.withColumn("content", F.concat("content", F.lit("\ndef stale(): pass\n")))
    drops = [files.where(key % 2 == 0).withColumn("arrival", F.lit(2))
             .unionByName(old.where(key % 6 == 0).withColumn("arrival", F.lit(1))),
             files.where(key % 2 == 1).unionByName(files.where(key % 8 == 0)).withColumn("arrival", F.lit(3)),
             edited.withColumn("arrival", F.lit(5))
             .unionByName(old.where(key % 3 == 0).withColumn("arrival", F.lit(1)))
             .unionByName(files.where(key % 7 == 1).withColumns({"content": F.lit(None).cast("string"),
                                                                 "arrival": F.lit(9)}))]
    store = T.TableStore(spark, f"{folder}/tables")
    for drop in drops:
        drop.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(drop.schema).parquet(f"{folder}/in")
        index_stream.stream_into_index(source, store, f"{folder}/checkpoint", "arrival", at())
    rows = [store.read(e).groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(e).alias("table_name"), "file_path", "n") for e in (*ENTITIES, "files")]
    return reduce(DataFrame.unionByName, rows)


@query
def i7_stream_index(spark, sf):
    files = feeds.document_files(load(spark, sf, "documents"))
    folder = new_folder(spark, "i7")
    rows = files.select("project_id", F.regexp_replace("file_path", r"\.\w+$", ".py")
                        .alias("file_path"), "content", F.lit(1).alias("arrival"), "doc_id")
    edited = rows.where("doc_id % 10 = 0").withColumns(
        {"content": F.concat("content", F.lit("\nedited")), "arrival": F.lit(2)})
    repeat = rows.where("doc_id % 3 = 0 and doc_id % 10 != 0").withColumn("arrival", F.lit(3))
    for drop in (rows, edited, repeat):
        drop.drop("doc_id").write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.drop("doc_id").schema).parquet(f"{folder}/in")
        index_stream.stream_index(source, f"{folder}/files", f"{folder}/checkpoint", "arrival")
    return index_stream.current_files(spark, f"{folder}/files").select(
        "file_path", "content_hash", "line_count", "byte_size")


# --- extraction -------------------------------------------------------------------------------

SYMBOL = ["file_path", "name", "qualified_name", "kind", "visibility", "start_line", "end_line",
          "start_col", "end_col", "signature", "docstring", "is_async", "is_static", "decorators"]


def _symbols(df: DataFrame) -> DataFrame:
    return joined(longs(df.select(*SYMBOL), "start_line", "end_line", "start_col", "end_col"),
                  "decorators")


def _types(df: DataFrame) -> DataFrame:
    return longs(df.select("file_path", "name", "kind", "type_expression", "start_line",
                           "end_line"), "start_line", "end_line")


def _imports(df: DataFrame) -> DataFrame:
    return joined(longs(df.select(
        "file_path", "module_path", "imported_names", "alias", "is_relative", "relative_level",
        "import_kind", "start_line"), "relative_level", "start_line"), "imported_names")


def _exports(df: DataFrame) -> DataFrame:
    return longs(df.select("file_path", "exported_name", "export_kind", "start_line"),
                 "start_line")


def _scopes(df: DataFrame) -> DataFrame:
    return longs(df.select("file_path", "kind", "name", "start_line", "end_line", "depth"),
                 "start_line", "end_line", "depth")


def _references(df: DataFrame) -> DataFrame:
    return longs(df.select("file_path", "name", "kind", "start_line", "start_col",
                           "is_definition"), "start_line", "start_col")


@query
def x1_python_symbols(spark, sf):
    return _symbols(extraction(spark, sf).python("symbols"))


@query
def x2_python_types(spark, sf):
    return _types(extraction(spark, sf).python("types"))


@query
def x3_python_imports(spark, sf):
    return _imports(extraction(spark, sf).python("imports"))


@query
def x4_python_exports(spark, sf):
    return _exports(extraction(spark, sf).python("exports"))


@query
def x5_python_scopes(spark, sf):
    return _scopes(extraction(spark, sf).python("scopes"))


@query
def x6_python_references(spark, sf):
    return _references(extraction(spark, sf).python("references"))


@query
def x7_script_symbols(spark, sf):
    return _symbols(extraction(spark, sf).script("symbols"))


@query
def x8_typescript_types(spark, sf):
    return _types(extraction(spark, sf).script("types"))


@query
def x9_script_imports(spark, sf):
    return _imports(extraction(spark, sf).script("imports"))


@query
def x10_script_exports(spark, sf):
    return _exports(extraction(spark, sf).script("exports"))


@query
def x11_script_scopes(spark, sf):
    return _scopes(extraction(spark, sf).script("scopes"))


@query
def x11_script_references(spark, sf):
    return _references(extraction(spark, sf).script("references"))


# --- documents --------------------------------------------------------------------------------

@query
def d1_index_documents(spark, sf):
    files = D.select_documents(feeds.document_files(load(spark, sf, "documents")))
    return longs(D.index_documents(files, at()), "word_count").select(
        "project_id", "file_path", "doc_type", "title", "format", "word_count", "content_hash")


@query
def d1_store_documents(spark, sf):
    """The totals of a second run over stored documents: some new, some changed, some unreadable."""
    files = feeds.document_files(load(spark, sf, "documents"))
    store = T.TableStore(spark, new_folder(spark, "d1"))
    D.store_documents(store, files.where("doc_id % 7 <> 3"), at())
    content = (F.when(F.col("doc_id") % 9 == 0, F.lit(None).cast("string"))
               .when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit("\nmore"))).otherwise(F.col("content")))
    totals = D.store_documents(store, files.withColumn("content", content), at())
    kept = store.read("documents").agg(F.count(F.lit(1)).alias("value")).select(F.lit("stored").alias("metric"), "value")
    return totals.unionByName(kept)


@query
def d1_document_totals(spark, sf):
    files = D.select_documents(feeds.document_files(load(spark, sf, "documents")))
    return longs(D.document_totals(D.index_documents(files, at())), "total_words")


@query
def d2_select_documents(spark, sf):
    return D.select_documents(feeds.document_files(load(spark, sf, "documents"))).select(
        "file_path")


@query
def d3_list_documents(spark, sf):
    rows = D.list_documents(document_rows(spark, sf), "src3", "api")
    return longs(rows, "word_count").select("file_path", "doc_type", "title", "format",
                                            "word_count")


@query
def d4_get_documents(spark, sf):
    paths = feeds.document_files(load(spark, sf, "documents")).where("doc_id % 3 = 0").select(
        "file_path")
    return D.get_documents(document_rows(spark, sf), "src4", paths).select(
        "file_path", "title", "content")


@query
def d5_search_documents(spark, sf):
    return longs(D.search_documents(document_rows(spark, sf), "src5", "The"), "word_count")


@query
def d5_search_by_index(spark, sf):
    """Stored documents, indexed in two runs, searched for a frequent text, a rare one and one without triples."""
    files = D.select_documents(feeds.document_files(load(spark, sf, "documents")))
    store = T.TableStore(spark, new_folder(spark, "d5"))
    D.store_documents(store, files.where("doc_id % 7 <> 3"), at())
    SI.index_texts(store)
    D.store_documents(store, files, at())
    SI.index_texts(store, files.where("doc_id % 7 = 3"))
    found = [SI.search_by_index(store, "src5", needle).select(F.lit(needle).alias("needle"), "*")
             for needle in ("The", "Heading 1", "ea")]
    return longs(reduce(DataFrame.unionByName, found), "word_count")


@query
def d6_document_breakdown(spark, sf):
    files = D.select_documents(feeds.document_files(load(spark, sf, "documents")))
    return D.document_breakdown(D.index_documents(files, at()))


@query
def d6_concept_coverage(spark, sf):
    files = D.select_documents(feeds.document_files(load(spark, sf, "documents")))
    return D.concept_coverage(files, ["the", "heading", "und", "eaux", "nowhere"])


# --- code queries -----------------------------------------------------------------------------

@query
def c1_find_symbols(spark, sf):
    found = C.find_symbols(index(spark, sf).read("symbols"), "proj-2", name="size%",
                           kind="function")
    return longs(found.drop("symbol_id"), "start_line", "end_line")


@query
def c2_file_symbols(spark, sf):
    found = C.file_symbols(index(spark, sf).read("symbols"), "proj-1", "src/m36.py")
    return longs(found.drop("symbol_id"), "start_line", "end_line")


@query
def c3_file_imports(spark, sf):
    return _imports(C.file_imports(index(spark, sf).read("imports"), "proj-1",
                                   "src/m37.js"))


@query
def c4_file_exports(spark, sf):
    return _exports(C.file_exports(index(spark, sf).read("exports"), "proj-1",
                                   "src/m36.py"))


@query
def c5_dependencies(spark, sf):
    rows = C.dependencies(index(spark, sf).read("imports"), "proj-3")
    return joined(longs(rows, "start_line"), "imported_names")


@query
def c6_find_references(spark, sf):
    return _references(C.find_references(index(spark, sf).read("references"), "proj-2",
                                         "total"))


@query
def c7_index_stats(spark, sf):
    store = index(spark, sf)
    tables = {e: store.read(e) for e in ENTITIES}
    files = store.read("files")
    again = files.where("line_count % 2 = 0").withColumn(
        "indexed_at", F.timestamp_seconds(F.lit(1600000000)))
    edges = G.resolve_references(tables["references"], tables["symbols"], G.resolve_imports(
        tables["imports"], files), at())
    stats = C.index_stats({"files": files.unionByName(again), **tables, "edges": edges})
    return stats.where("metric != 'last_indexed'")


@query
def c8_symbols_across_projects(spark, sf):
    rows = C.symbols_across_projects(index(spark, sf).read("symbols"),
                                     feeds.projects(load(spark, sf, "part")), F.col("is_async"))
    return longs(rows, "start_line")


@query
def c9_project_overview(spark, sf):
    rows = C.project_overview(feeds.projects(load(spark, sf, "part")),
                              index(spark, sf).read("files"),
                              index(spark, sf).read("symbols"))
    return rows.select("project_name", "git_commit", "file_count", "symbol_count")


# --- graph ------------------------------------------------------------------------------------

@query
def g1_dependency_edges(spark, sf):
    return G.dependency_edges(index(spark, sf).read("imports")).drop("project_id")


@query
def g1_page_fan_in(spark, sf):
    return G.module_fan_in(G.page_links(load(spark, sf, "pages")), "page_id", "target")


@query
def g1_page_fan_out(spark, sf):
    return G.module_fan_out(G.page_links(load(spark, sf, "pages")), "page_id", "target")


@query
def g2_resolve_imports(spark, sf):
    rows = G.resolve_imports(index(spark, sf).read("imports"),
                             index(spark, sf).read("files"))
    return longs(rows.select("file_path", "module_path", "start_line", "target_file"),
                 "start_line")


@query
def g3_resolve_references(spark, sf):
    store = index(spark, sf)
    resolved = G.resolve_imports(store.read("imports"), store.read("files"))
    edges = G.resolve_references(store.read("references"), store.read("symbols"), resolved, at())
    return longs(edges.select("source_file", "source_line", "source_col", "target_file",
                              "target_line", "target_col", "edge_type", "resolved_by"),
                 "source_line", "source_col", "target_line", "target_col")


@query
def g3_names_through_files(spark, sf):
    """Calls resolved through chains of up to thirty files, a circle, and names that one file alone defines."""
    files = I.detect_language(feeds.chained_files(load(spark, sf, "part")))
    tables = Extraction(files, keep=True).stored("symbols", "imports", "exports", "references")
    symbols = tables["symbols"]
    resolved = G.resolve_imports(tables["imports"], files)
    edges = G.resolve_everywhere(tables["references"], symbols, resolved, tables["exports"], at())
    names = symbols.select(F.col("symbol_id").alias("source_symbol_id"), F.col("name").alias("source_name"))
    calls = edges.where("edge_type = 'call'").join(names, "source_symbol_id", "left")
    return longs(calls.select("source_file", "source_line", "source_col", "source_name", "target_file",
                              "target_line"), "source_line", "source_col", "target_line")


@query
def g4_assign_scope(spark, sf):
    store = index(spark, sf)
    rows = store.read("references").select("project_id", "file_path", "name", "start_line",
                                           "start_col")
    found = G.assign_scope(rows, store.read("scopes"), take={
        "kind": "scope_kind", "name": "scope_name", "depth": "scope_depth"})
    return longs(found.drop("project_id"), "start_line", "start_col", "scope_depth")


@query
def g5_qualify_symbols(spark, sf):
    symbols = index(spark, sf).read("symbols").drop("metadata")
    bare = symbols.withColumns({"qualified_name": F.col("name"),
                                "parent_symbol_id": F.lit(None).cast("string")})
    rows = G.qualify_symbols(bare)
    return longs(rows.select("file_path", "name", "start_line", "qualified_name", "depth"),
                 "start_line", "depth")


# --- sessions ---------------------------------------------------------------------------------

def _numbered(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = feeds.messages(load(spark, sf, "conversations"))
    first = rows.where("turn < 3").withColumn("sequence_number", F.col("turn") + 1)
    return first, rows.where("turn >= 3")


@query
def s1_append_messages(spark, sf):
    first, later = _numbered(spark, sf)
    added = S.append_messages(first, later, "turn")
    return first.unionByName(added).select("session_id", "turn", "role", "sequence_number")


@query
def s2_session_rollup(spark, sf):
    return S.session_rollup(feeds.messages(load(spark, sf, "conversations")))


@query
def s3_session_messages(spark, sf):
    rows = feeds.messages(load(spark, sf, "conversations")).withColumnRenamed(
        "turn", "sequence_number")
    wanted = rows.where("project_id = '2'").select("session_id")
    return S.session_messages(rows, wanted, 4).select("session_id", "sequence_number", "role",
                                                      "content")


def _sessions(spark, sf) -> DataFrame:
    """Sessions with two versions: created with the first message, updated with the last."""
    rollup = S.session_rollup(feeds.messages(load(spark, sf, "conversations")))
    text = F.lit(None).cast("string")
    n = F.col("session_id").cast("bigint")

    def version(at, count):
        return rollup.select(
            "session_id", "project_id", F.concat(F.lit("chat "), "session_id").alias("title"),
            text.alias("description"), text.alias("model"), text.alias("provider"),
            count.alias("message_count"), "token_count",
            F.timestamp_seconds(F.lit(1704067200)).alias("created_at"),
            F.timestamp_seconds(at).alias("updated_at"),
            F.lit(None).cast("timestamp").alias("archived_at"), F.lit("{}").alias("metadata"))

    return version(1704067200 + n, F.lit(1).cast("bigint")).unionByName(
        version(1704070000 + n, F.col("message_count")))


@query
def s4_list_sessions(spark, sf):
    return S.list_sessions(_sessions(spark, sf), "3").select(
        "session_id", "title", "message_count", "token_count")


@query
def s5_archive_sessions(spark, sf):
    newest = V.latest_by_key(_sessions(spark, sf), ["project_id", "session_id"], "updated_at")
    ids = newest.where("cast(session_id as bigint) % 5 = 1").select("project_id", "session_id")
    rows = S.archive_sessions(newest, ids, F.timestamp_seconds(F.lit(1710000000)))
    return rows.select("session_id", "message_count",
                       F.unix_timestamp("archived_at").alias("archived"),
                       F.unix_timestamp("updated_at").alias("updated"))


@query
def s6_stream_session_rollup(spark, sf):
    rows = feeds.messages(load(spark, sf, "conversations"))
    folder = new_folder(spark, "s6")
    for drop in (rows.where("turn < 3"), rows.where("turn >= 2")):
        drop.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        session_stream.stream_session_rollup(source, f"{folder}/out", f"{folder}/checkpoint",
                                             ["session_id", "turn"])
    return session_stream.current_rollup(spark, f"{folder}/out")


@query
def s6_stream_activity(spark, sf):
    """Closed daily windows; repeated events within a day are dropped."""
    folder = new_folder(spark, "s6a")
    events = load(spark, sf, "events")
    events.unionByName(events.where("event_id % 3 = 0")).write.parquet(f"{folder}/in/a")
    last = events.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("bigint").alias("event_id"),
        F.expr("ts + interval 10 days").alias("ts"), F.lit(0).cast("bigint").alias("user_id"),
        F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    source = (spark.readStream.schema(events.schema).option("recursiveFileLookup", True)
              .parquet(f"{folder}/in"))
    for rows in (None, last):
        if rows is not None:
            rows.write.parquet(f"{folder}/in/b")
        session_stream.stream_activity(source, f"{folder}/out", f"{folder}/checkpoint", "ts",
                                       "event_id")
    return spark.read.parquet(f"{folder}/out").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "messages")


@query
def s6_stream_sessions(spark, sf):
    """Visits of a user, cut at gaps of six hours: a ninth of the events comes late, one far too late."""
    folder, events = new_folder(spark, "s6s"), load(spark, sf, "events")
    late = F.col("event_id") % 9 == 4
    last = events.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("bigint").alias("event_id"), F.expr("ts + interval 100 days").alias("ts"),
        F.lit(-1).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"),
        F.lit("{}").alias("props"))
    drops = [events.where(~late).unionByName(events.where(~late & (F.col("event_id") % 3 == 0))),
             events.where(late), last, events.orderBy("event_id").limit(1).withColumn("event_id", F.lit(-2).cast("bigint"))]
    too_late = 0
    for drop in drops:
        drop.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        too_late += session_stream.stream_sessions(
            source, f"{folder}/out", f"{folder}/checkpoint", ["user_id"], "ts", ["event_id"], "6 hours",
            "40 days")["too_late"]
    return spark.read.parquet(f"{folder}/out").select(
        "user_id", "events", F.unix_micros("first_at").alias("first_at"), F.unix_micros("last_at").alias("last_at"),
        F.lit(too_late).cast("bigint").alias("too_late"))


@query
def s6_compacted_rollup(spark, sf):
    """The streamed rollup with partial sums added up between the drops."""
    rows = feeds.messages(load(spark, sf, "conversations"))
    folder = new_folder(spark, "s6c")
    for drop in (rows.where("turn < 2"), rows.where("turn between 1 and 3"), rows.where("turn >= 3")):
        drop.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        session_stream.stream_session_rollup(source, f"{folder}/out", f"{folder}/checkpoint",
                                             ["session_id", "turn"])
        session_stream.compact_rollup(spark, f"{folder}/out")
    return session_stream.current_rollup(spark, f"{folder}/out")


# --- todos ------------------------------------------------------------------------------------

@query
def k1_upsert_todos(spark, sf):
    base = feeds.todos(load(spark, sf, "orders"))
    text = F.lit(None).cast("string")
    ids = base.select("todo_id", F.col("todo_id").cast("bigint").alias("n"))
    update = ids.where("n % 10 = 0").select("todo_id", text.alias("title"),
                                            F.lit("done").alias("status"))
    create = ids.where("n % 10 = 1").select(F.concat(F.lit("new-"), "todo_id").alias("todo_id"),
                                            F.lit("fresh").alias("title"), text.alias("status"))
    return K.upsert_todos(base, update.unionByName(create)).select(
        "todo_id", "title", "status", "priority", "project_id")


@query
def k2_list_todos(spark, sf):
    rows = K.list_todos(feeds.todos(load(spark, sf, "orders")), project="4", status="O",
                        tag="high")
    return joined(rows.select("todo_id", "priority", "assigned_to", "tags",
                              F.col("created_at").cast("string").alias("created_at")), "tags")


@query
def k3_delete_todos(spark, sf):
    rows = K.delete_todos(feeds.todos(load(spark, sf, "orders")),
                          {"status": "F", "priority": "5-LOW"})
    return rows.select("todo_id", "status", "priority")


@query
def m1_metadata(spark, sf):
    """Set, get-all and initialise on a key-value table."""
    rows = load(spark, sf, "events").select(
        F.concat("event_type", F.lit("-"), F.col("user_id") % 10).alias("key"),
        F.col("value").cast("string").alias("value"), F.col("event_id").alias("updated_at"))
    known = V.latest_by_key(rows.where("event_id % 2 = 0"), ["key"], "updated_at")
    absent = V.insert_absent(known, V.latest_by_key(rows, ["key"], "updated_at"), ["key"])
    return known.unionByName(absent).select("key", "value")
