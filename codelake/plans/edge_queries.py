"""Queries over awkward values and repeated keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake import feeds
from codelake.operators import projects as P
from codelake.operators import sessions as S
from codelake.operators import versions as V
from codelake.plans.registered import TABLES, load
from codelake.session import new_folder
from codelake.sources import scan as I
from codelake.sources import tables as T


def _folder_name(column: str):
    """A value as Spark names the folder of a partition: odd characters as %XX, a name of its own for null and empty."""
    odd = [*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"]
    pairs = F.create_map(*[F.lit(x) for c in odd for x in (c, f"%{ord(c):02X}")])
    text = F.col(column).cast("string")
    shown = F.when(text.rlike(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]"""), F.array_join(F.transform(
        F.split(text, ""), lambda c: F.coalesce(pairs[c], c)), "")).otherwise(text)
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))


def i1_scan_contents(spark, sf):
    """Texts written as files of a source and at most fifty ids each, scanned back with content."""
    folder = new_folder(spark, "i1")
    docs = load(spark, sf, "documents").select("source", "doc_id", "text", F.floor(F.col("doc_id") / 50).alias("part"))
    path = F.concat(F.lit("source="), _folder_name("source"), F.lit("/part="), _folder_name("part"), F.lit(".txt"))
    I.write_texts(docs.select(path.alias("file_path"), "doc_id", "text"), folder, ["doc_id"])
    files = I.scan_files(spark, folder, extensions=[".txt"], max_bytes=1 << 30)
    facts = I.file_facts(files)
    name = F.concat_ws("/", F.regexp_extract("file_path", "source=([^/]*)", 1),
                       F.regexp_extract("file_path", r"part=([^/]*)\.txt$", 1))
    return facts.select(name.alias("name"), "content_hash",
                        "byte_size", "line_count", F.sha2("content", 256).alias("decoded_hash"))


def i4_diff_with_errors(spark, sf):
    """Files that could not be read are told as failed, and only scanned projects miss files."""
    files = feeds.document_files(load(spark, sf, "documents"))
    indexed = I.file_facts(files).withColumn("indexed_at", F.lit(1))
    scan = I.file_facts(files.where("doc_id % 6 != 5 AND project_id != 'src3'")).withColumns({
        "language": F.lit("text"), "error_message": F.when(F.col("doc_id") % 8 == 0, "no permission")})
    return I.diff_files(scan, indexed).groupBy("project_id", "status").agg(F.count(F.lit(1)).alias("files"))


def t2_mixed_types(spark, sf):
    """Numbers of two kinds under one key, whose type holds both (whole numbers count as 20 digits), and
    broken records."""
    value = F.when(F.col("event_id") % 2 == 0, "1").otherwise("2.5")
    text = F.when(F.col("event_id") % 10 == 7, "{broken").otherwise(
        F.concat(F.lit('{"v": '), value, F.lit(', "s": "x"}')))
    return T.infer_schema(load(spark, sf, "events").select(text.alias("j")), "j")


def t3_odd_partitions(spark, sf):
    """A partition column with null, a leading zero and characters that folders escape."""
    orders = load(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.expr("element_at(array(NULL, '007', 'a:b', 'x=y z', '1'), CAST(o_orderkey % 5 + 1 AS INT))").alias("part"))
    store = T.TableStore(spark, new_folder(spark, "t3"))
    store.append("orders", orders, partition_by=["part"])
    removed = store.delete_where("orders", {"o_orderstatus": "F"})
    return store.read("orders").select("o_orderkey", "part", F.lit(removed).cast("bigint").alias("removed"))


def t5_csv_texts(spark, sf):
    """Whole texts with their line breaks through CSV and back, empty unlike null."""
    docs = load(spark, sf, "documents").select("doc_id", F.expr(
        "CASE doc_id % 50 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text END").alias("text"))
    path = new_folder(spark, "t5")
    T.export_rows(docs, path, "csv")
    return T.import_rows(spark, path, "csv", docs.schema)


def t7_store_totals(spark, sf):
    totals = T.store_totals(T.table_stats({t: load(spark, sf, t) for t in TABLES}))
    return totals.select("table_count", "row_count", (F.col("byte_size") > 0).alias("has_bytes"))


def t7_tables_have_bytes(spark, sf):
    stats = T.table_stats({t: load(spark, sf, t) for t in TABLES})
    return stats.select("table_name", (F.col("byte_size") > 0).alias("has_bytes"))


def v2_newest_change(spark, sf):
    """Three changes for every tenth key: the newest counts."""
    base = load(spark, sf, "customer")
    changes = base.where("c_custkey % 10 = 0").select(
        "c_custkey", "c_acctbal", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("version"))
    changes = changes.withColumn("c_acctbal", F.col("c_acctbal") + F.col("version"))
    return V.apply_changes(base, changes, ["c_custkey"], version="version").select("c_custkey", "c_name", "c_acctbal")


def v3_history_of_text_order(spark, sf):
    """Numbering by a text column, with one key that holds a third of the rows."""
    rows = load(spark, sf, "events").select(
        "event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END").alias("key"),
        F.format_string("%012d", F.col("event_id") * 7919 % 1000003).alias("at"))
    return V.version_history(rows, ["key"], "at", "event_id", ["event_id"]).select(
        "event_id", "key", "version_no", "previous_value")


def v4_cascade_survivors(spark, sf):
    """What a cascade leaves of each table."""
    customer, orders = load(spark, sf, "customer"), load(spark, sf, "orders")
    doomed = customer.where("c_custkey % 10 = 3").select("c_custkey")
    kept, _ = V.cascade_delete({"customer": (customer, "c_custkey"), "orders": (orders, "o_custkey")},
                               {"customer": doomed, "orders": doomed})
    return kept["customer"].select(F.lit("customer").alias("name"), F.col("c_custkey").alias("id")).unionByName(
        kept["orders"].select(F.lit("orders").alias("name"), F.col("o_orderkey").alias("id")))


def s2_rollup_times(spark, sf):
    """Partial rollups of even and odd turns, merged; first and last turn survive."""
    messages = feeds.messages(load(spark, sf, "conversations"))
    halves = [S.session_rollup(messages.where(F.col("turn") % 2 == k), time="turn") for k in (0, 1)]
    return S.merge_rollups(halves[0].unionByName(halves[1])).select(
        "session_id", "project_id", "message_count", "first_at", "last_at")


def p6_approximate_is_close(spark, sf):
    """An approximate distinct count within a tenth of the exact one."""
    row = load(spark, sf, "lineitem").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("near"),
                                         F.count_distinct("l_orderkey").alias("exact"))
    return row.select((F.abs(F.col("near") - F.col("exact")) <= F.col("exact") * 0.1).alias("close"), "exact")


def r1_update_project(spark, sf):
    """One project moved to another branch, one created: the newest row of every name."""
    rows = feeds.projects(load(spark, sf, "part"))
    later = F.timestamp_seconds(F.lit(1704200000))
    moved = P.update_project(rows, "name-2", later, git_branch="dev", git_commit="c9")
    made = P.create_project(rows, "proj-new", "fresh", "/new", later, git_branch="main")
    return P.newest_projects(rows.unionByName(moved).unionByName(made)).select(
        "project_id", "project_name", "git_branch", "git_commit")


def r2_files_of_project(spark, sf):
    """Files of a project by its name, and of a name that is unknown."""
    part = load(spark, sf, "part")
    names = [P.of_project(feeds.corpus(part), feeds.projects(part), n).withColumn("asked", F.lit(n))
             for n in ("name-1", "nobody")]
    return names[0].unionByName(names[1]).select("asked", "project_id", "file_path")


def r3_delete_project(spark, sf):
    """Rows that a deletion removes from each stored table, and rows that stay."""
    part = load(spark, sf, "part")
    store = T.TableStore(spark, new_folder(spark, "r3"))
    store.append("projects", feeds.projects(part))
    store.append("files", feeds.corpus(part), partition_by=["project_id"])
    store.append("regions", load(spark, sf, "region"))
    removed = P.delete_project(store, "proj-1")
    rows = [store.read(n).agg(F.count(F.lit(1)).alias("stay")).select(
        F.lit(n).alias("table_name"), F.lit(removed.get(n, 0)).cast("bigint").alias("removed"), "stay")
        for n in ("projects", "files", "regions")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES = {f.__name__: f for f in (
    i1_scan_contents, i4_diff_with_errors, t2_mixed_types, t3_odd_partitions, t5_csv_texts, t7_store_totals,
    t7_tables_have_bytes, v2_newest_change, v3_history_of_text_order, v4_cascade_survivors, s2_rollup_times,
    p6_approximate_is_close, r1_update_project, r2_files_of_project, r3_delete_project)}

SQL = {
    "i1_scan_contents": """
WITH f AS (SELECT source || '/' || doc_id // 50 AS name, string_agg(text || chr(10), '' ORDER BY doc_id) AS t
           FROM documents GROUP BY 1)
SELECT name, sha256(t) AS content_hash, strlen(t) AS byte_size,
       length(t) - length(replace(t, chr(10), '')) + 1 AS line_count, sha256(t) AS decoded_hash FROM f""",
    "i4_diff_with_errors": """
SELECT source AS project_id, CASE WHEN doc_id % 6 = 5 THEN 'file_not_found' WHEN doc_id % 8 = 0 THEN 'failed'
       ELSE 'unchanged' END AS status, count(*) AS files
FROM documents WHERE source <> 'src3' GROUP BY ALL""",
    "t2_mixed_types": """
SELECT 'v' AS key, 'DECIMAL(21,1)' AS type, count(*) AS row_count FROM events WHERE event_id % 10 <> 7
UNION ALL SELECT 's', 'STRING', count(*) FROM events WHERE event_id % 10 <> 7
UNION ALL SELECT NULL, 'MALFORMED', count(*) FROM events WHERE event_id % 10 = 7""",
    "t3_odd_partitions": """
SELECT o_orderkey, [NULL, '007', 'a:b', 'x=y z', '1'][CAST(o_orderkey % 5 + 1 AS INT)] AS part,
       (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS removed
FROM orders WHERE o_orderstatus <> 'F'""",
    "t5_csv_texts": """
SELECT doc_id, CASE doc_id % 50 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE text END AS text FROM documents""",
    "t7_store_totals": "SELECT " + str(len(TABLES)) + " AS table_count, " + " + ".join(
        f"(SELECT count(*) FROM {t})" for t in TABLES) + " AS row_count, true AS has_bytes",
    "t7_tables_have_bytes": " UNION ALL ".join(f"SELECT '{t}' AS table_name, true AS has_bytes" for t in TABLES),
    "v2_newest_change": """
SELECT c_custkey, c_name, c_acctbal + CASE WHEN c_custkey % 10 = 0 THEN 3 ELSE 0 END AS c_acctbal FROM customer""",
    "v3_history_of_text_order": """
WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS key,
                  event_id * 7919 % 1000003 AS turn FROM events)
SELECT event_id, key, row_number() OVER w AS version_no, lag(event_id) OVER w AS previous_value
FROM r WINDOW w AS (PARTITION BY key ORDER BY turn, event_id)""",
    "v4_cascade_survivors": """
SELECT 'customer' AS name, c_custkey AS id FROM customer WHERE c_custkey % 10 <> 3
UNION ALL SELECT 'orders', o_orderkey FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3)""",
    "s2_rollup_times": """
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(conv_id % 5 AS VARCHAR) AS project_id,
       count(*) AS message_count, min(turn) AS first_at, max(turn) AS last_at
FROM conversations GROUP BY conv_id""",
    "p6_approximate_is_close": "SELECT true AS close, count(DISTINCT l_orderkey) AS exact FROM lineitem",
    "r1_update_project": """
SELECT DISTINCT 'proj-' || (p_partkey // 30) AS project_id, 'name-' || (p_partkey // 30) AS project_name,
       CASE p_partkey // 30 WHEN 2 THEN 'dev' ELSE 'main' END AS git_branch,
       CASE p_partkey // 30 WHEN 2 THEN 'c9' ELSE 'c3' END AS git_commit FROM part
UNION ALL SELECT 'proj-new', 'fresh', 'main', NULL""",
    "r2_files_of_project": """
SELECT 'name-1' AS asked, 'proj-1' AS project_id,
       'src/m' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.js' ELSE '.ts' END AS file_path
FROM part WHERE p_partkey // 30 = 1""",
    "r3_delete_project": """
WITH p AS (SELECT p_partkey // 30 AS n FROM part), d AS (SELECT DISTINCT n FROM p)
SELECT 'projects' AS table_name, 3 * count(*) FILTER (n = 1) AS removed, 3 * count(*) FILTER (n <> 1) AS stay FROM d
UNION ALL SELECT 'files', count(*) FILTER (n = 1), count(*) FILTER (n <> 1) FROM p
UNION ALL SELECT 'regions', 0, count(*) FROM region""",
}
