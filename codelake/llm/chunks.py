"""Chunks of documents that ask a question about the whole corpus and get the answer back.

Rows are dealt by hash into chunks of bounded size and written once as a bucketed table, so that later
passes group by chunk without another shuffle of the texts. A pass over the chunks makes requests:
for each chunk and each range of 64-bit keys one row with the distinct keys of the chunk in order and
what it knows about them. Requests are grouped by range, which no key can make larger than the
number of chunks allows, however frequent it is in the documents; the answers are arrays in the
order of the keys asked for, and go back to the chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.common import ship
from codelake.session import new_folder

ship(__name__)

MAX_BUCKETS = 50_000


def chunk_count(docs: DataFrame, text_column: str, size: int) -> int:
    """Chunks of about size bytes that hold all texts of docs."""
    total = docs.agg(F.sum(F.octet_length(text_column).cast("long"))).first()[0] or 0
    return int(min(MAX_BUCKETS, max(1, -(-total // size))))


def bucketed(df: DataFrame, column: str, n: int, label: str) -> DataFrame:
    """df written to the shared folder in n buckets of column, and read back."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    (df.repartition(n, column).write.format("parquet").option("compression", "zstd")
     .option("path", new_folder(spark, label)).bucketBy(n, column).saveAsTable(name))
    return spark.table(name)


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, so that their high bytes, mostly alike, compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    rows = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(rows.T).reshape(-1).view(kind)


def ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """For each of so many ranges of the unsigned 64-bit keys, in order, where it starts; then the end."""
    marks = (np.arange(1, ranges, dtype=object) << 64) // ranges
    cuts = np.searchsorted(keys, np.array(marks, np.uint64)) if ranges > 1 else np.zeros(0, int)
    return np.concatenate([[0], cuts, [len(keys)]]).astype(np.int64)


REQUEST = "chunk int, kind int, part int, keys binary, facts array<binary>"
ANSWER = "chunk int, kind int, part int, answer binary"


def requests_of(chunk: int, kind: int, ranges: int, keys: np.ndarray,
                facts: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of REQUEST for the sorted keys of a chunk."""
    cuts = ranges_of(keys, ranges)
    some = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
    return pa.RecordBatch.from_arrays([
        pa.array([chunk] * len(some), pa.int32()), pa.array([kind] * len(some), pa.int32()),
        pa.array(some, pa.int32()),
        pa.array([keys[cuts[i]:cuts[i + 1]].tobytes() for i in some], pa.binary()),
        pa.array([[planes(f[cuts[i]:cuts[i + 1]]) for f in facts] for i in some], pa.list_(pa.binary()))],
        names=["chunk", "kind", "part", "keys", "facts"])


def answered(requests: DataFrame, answer: Callable, types: list[type]) -> DataFrame:
    """Rows of ANSWER. answer(kind, chunks, keys, facts) gets one range: for each asked key the chunk
    that asks, the key and its facts; it returns an array in that order and extra rows, if any, as
    (chunk, kind, array)."""
    def run(key: tuple, groups: pa.Table) -> pa.Table:
        kind, part = key[0].as_py(), key[1].as_py()
        asked = [np.frombuffer(k.as_buffer(), np.uint64) for k in groups["keys"]]
        sizes = [len(k) for k in asked]
        own = groups["chunk"].to_numpy()
        chunks = np.repeat(own, sizes)
        stacks = groups["facts"].to_pylist()
        facts = [np.concatenate([unplaned(s[i], t) for s in stacks]) for i, t in enumerate(types)]
        values, extra = answer(kind, chunks, np.concatenate(asked), facts)
        cuts = np.cumsum(sizes)[:-1]
        rows = [(int(c), kind, part, planes(v)) for c, v in zip(own, np.split(values, cuts), strict=True)]
        rows += [(c, k, part, planes(v)) for c, k, v in extra]
        columns = list(zip(*rows, strict=True))
        return pa.Table.from_arrays([
            *(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.binary())],
            names=["chunk", "kind", "part", "answer"])

    return requests.groupBy("kind", "part").applyInArrow(run, ANSWER)


def answers_in(table: pa.Table, kind: int, of: type) -> np.ndarray:
    """The answers of one kind to a chunk, in the order of its keys."""
    rows = sorted((p, a) for k, p, a in zip(*(table[c].to_pylist() for c in ("kind", "part", "answer")),
                                            strict=True) if k == kind)
    return np.concatenate([unplaned(a, of) for _, a in rows]) if rows else np.zeros(0, of)


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit numbers spread evenly."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def groups(sizes: list[int], most: int) -> Iterator[slice]:
    """Neighbours whose sizes add up to at most so much, or single ones."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))
