"""Text search over stored documents by an index of byte triples.

The index lies in the same folders as the documents table (`sources/buckets.py`) and is made anew for the
folders whose documents changed. Each document has a slot, the hash of its path, on one of the pages of its
folder; a page has 32,768 slots and a folder as many pages as its documents need. For each hashed triple of
bytes and each page the index keeps Spark's bitmap of the slots whose texts hold the triple.

A search reads the bitmaps of its own triples, joins them by AND, and looks the documents' slots up in what is
left. Triples and slots may collide, so this gives candidates: contents are read of these only and searched by
`search_documents`. A text of fewer than three bytes has no triple and is answered by the scan.

Edge cases: a document without content holds no triple and is found by nothing. A folder that was never
indexed is not searched, so run `index_texts` after each change. Without documents nothing is found.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelake.operators.documents import search_documents
from codelake.sources.buckets import FOLDERS, BucketTable
from codelake.sources.tables import TableStore

# Executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["project_id", "file_path"]
SLOTS = 8 * 4096  # of a page: one bitmap of Spark's bitmap functions
DOCUMENTS = SLOTS // 4  # that a page is made for
TRIPLES = 1 << 13  # hashed triples of bytes
NAMED = 200  # candidates that are named to the reader, so that it opens their pages only
_SCHEMA = "_project int, _bucket int, pages int, page int, triple int, bits binary"


def triples(text: bytes) -> np.ndarray:
    """The distinct hashed triples of bytes of a text."""
    codes = np.frombuffer(text, np.uint8).astype(np.uint32)
    mixed = (codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]) * np.uint32(2654435761)
    return np.unique(mixed >> np.uint32(32 - TRIPLES.bit_length() + 1))


def _slot() -> Column:
    """A number of the document; page and place on it are taken from different parts."""
    return F.xxhash64(*KEY, F.lit("slot"))


def _page(pages: str = "pages") -> Column:
    return F.pmod(F.shiftrightunsigned(_slot(), 15), F.col(pages)).cast("int")


def _place() -> Column:
    return F.pmod(_slot(), F.lit(SLOTS)).cast("int")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's triples as one bit each."""
    for batch in batches:
        out = []
        for text in batch.column(batch.num_columns - 1):
            held = np.zeros(TRIPLES, bool)
            data = text.as_py()
            if len(data) > 2:
                held[triples(data)] = True
            out.append(np.packbits(held, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())],
                                         names=[*batch.schema.names[:-1], "held"])


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From bits of triples by slot to bits of slots by triple; rows come ordered by page, one is held."""
    def rows(key: tuple, places: list[int], held: list[bytes]) -> Iterator[pa.RecordBatch]:
        slots, bits = np.array(places), np.frombuffer(b"".join(held), np.uint8).reshape(len(held), -1)
        for start in range(0, bits.shape[1], 16):
            doc, triple = np.nonzero(np.unpackbits(bits[:, start:start + 16], axis=1, bitorder="little"))
            some, row = np.unique(triple, return_inverse=True)
            if len(some):
                out = np.zeros((len(some), SLOTS), np.uint8)
                out[row, slots[doc]] = 1
                out = np.packbits(out, axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([v] * len(some), pa.int32()) for v in key), pa.array(start * 8 + some, pa.int32()),
                     pa.array([x.tobytes() for x in out], pa.binary())],
                    names=["_project", "_bucket", "pages", "page", "triple", "bits"])

    at, places, held = None, [], []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for *key, place, one in zip(*columns, strict=True):
            if key != at and held:
                yield from rows(tuple(at), places, held)
                places, held = [], []
            at = key
            places.append(place)
            held.append(one)
    if held:
        yield from rows(tuple(at), places, held)


def _path(store: TableStore) -> str:
    return f"{store.root}/.document_triples"


def _index(store: TableStore) -> DataFrame | None:
    spark, path = store.spark, store.spark._jvm.org.apache.hadoop.fs.Path(_path(store))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(_SCHEMA).parquet(_path(store))


def index_texts(store: TableStore, changed: DataFrame | None = None) -> None:
    """Bring the index up to the stored documents: in the folders of the changed (project_id, file_path), or all.

    Running it again gives the same index."""
    table: BucketTable = store.bucketed("documents")
    docs = table.read().select(*KEY, "content", *table._folders())
    touched = None if changed is None else table._touched(changed)
    if touched is not None:
        if not touched:
            return
        docs = docs.where(table._inside(touched))
    # One row a folder, of a fixed number of folders.
    sizes = {tuple(r[f] for f in FOLDERS): r.n for r in
             docs.groupBy(*FOLDERS).agg(F.count(F.lit(1)).alias("n")).collect()}
    folders = [(*f, 1 << max(0, (n - 1) // DOCUMENTS).bit_length()) for f, n in sizes.items()]
    pages = store.spark.createDataFrame(folders, "_project int, _bucket int, pages int")
    place = [*FOLDERS, "pages", "page"]
    # Bits of a page are many times the bytes shuffled, so the number of tasks follows the pages.
    tasks = max(int(store.spark.conf.get("spark.sql.shuffle.partitions")), sum(n for *_, n in folders) // 8)
    rows = docs.join(F.broadcast(pages), FOLDERS).select(
        *FOLDERS, "pages", _page().alias("page"), _place().alias("place"),
        F.coalesce(F.lower("content"), F.lit("")).cast("binary").alias("text"))
    bits = (rows.mapInArrow(_signatures, "_project int, _bucket int, pages int, page int, place int, held binary")
            .repartition(tasks, *place).sortWithinPartitions(*place).mapInArrow(_turned, _SCHEMA))
    # A folder without documents is overwritten by a row without a triple.
    empty = store.spark.createDataFrame([f for f in touched or [] if f not in sizes], "_project int, _bucket int")
    empty = empty.select(*FOLDERS, F.lit(1).alias("pages"), *[F.lit(None).cast(t).alias(c) for c, t in (
        ("page", "int"), ("triple", "int"), ("bits", "binary"))])
    (bits.unionByName(empty).hint("rebalance", *FOLDERS).sortWithinPartitions(*FOLDERS, "triple", "page")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if touched is not None else "static")
     .partitionBy(*FOLDERS).parquet(_path(store)))


def candidates(store: TableStore, project: str, query: str) -> DataFrame | None:
    """(project_id, file_path) of the documents that may hold the text; none for a text without triples."""
    data = query.lower().encode()
    if len(data) < 3:
        return None
    table = store.bucketed("documents")
    docs = table.read(project).select(*KEY, *table._folders())
    index = _index(store)
    if index is None:
        return docs.select(*KEY).where("false")
    wanted = [int(t) for t in triples(data)]
    index = index.where(F.col("_project") == table._folder("projects", F.lit(project)))
    # The pages of each folder, of which there is a fixed number.
    pages = index.select(*FOLDERS, "pages").distinct()
    held = (index.where(F.col("triple").isin(wanted)).groupBy(*FOLDERS, "page")
            .agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == len(wanted)).drop("n"))
    docs = docs.join(pages, FOLDERS).select("*", _page().alias("page"), _place().alias("place"))
    byte = F.substring("bits", F.shiftright("place", 3) + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("bigint")
    return (docs.join(held, [*FOLDERS, "page"])
            .where(F.getbit(value, F.col("place").bitwiseAND(7)) == 1).select(*KEY))


def search_by_index(store: TableStore, project: str, query: str, limit: int | None = None) -> DataFrame:
    """The rows of search_documents. A few candidates are named to the reader, which then skips what is between
    them; more are found by a semi join of the folders' documents."""
    table = store.bucketed("documents")
    found = candidates(store, project, query)
    docs = table.read(project)
    if found is not None:
        some = [r.file_path for r in found.select("file_path").limit(NAMED + 1).collect()]
        if len(some) > NAMED:
            docs = docs.join(found, KEY, "left_semi")
        elif some:
            docs = docs.where(reduce(lambda a, b: a | b, [F.col("file_path") == p for p in some]))
        else:
            docs = docs.where("false")
    return search_documents(docs, project, query, limit)
