"""SimHash near-dedup with anchor points.

Two fingerprints of 64 bits that differ in at most three bits agree in one of their halves up to
one bit. The anchors of a half are the words of a perfect code: 31 bits of a Hamming code, whose
balls of radius one cover everything, and one free bit. A fingerprint is at home at its nearest
anchor and also visits every anchor within covering radius plus one; of a linked pair, one visits
the home of the other in some half. Members are compared only at an anchor, and only a spanning
forest of the links found there is passed on, so groups of copies give no quadratic output.

Equal fingerprints are one from the start. An anchor that is home to very many fingerprints is cut
into tiles of homes, and its visitors go to every tile, so that no task holds all of it.

Edge cases: a null text counts as empty; a text without words has fingerprint zero, which links
like any other. A null id is ignored when the smallest id of a component is looked for. Rows that
share an id are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import fresh, rows_of, ship, sliced, stored, table, text_bytes
from codelake.llm.components import components

ship(__name__)

RADIUS = 3
#: Homes of one anchor that a task compares at once.
TILE = 4096


def fingerprint(text: bytes, width: int, block: int = 1 << 17, seed: int = 42) -> int:
    """Bits set in over half the XXH64 of the shingles, as a signed number."""
    words = text.lower().split()
    if not words:
        return 0
    counts, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    hashed = xxhash.xxh64_intdigest
    for start in range(0, n, block):
        some = words[start:start + block + width - 1]
        shingles = (zip(*(some[i:] for i in range(width)), strict=False) if len(words) >= width
                    else [some])
        values = np.fromiter((hashed(b" ".join(s), seed) for s in shingles), np.uint64)
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(counts * 2 > n, bitorder="little").view("<i8")
    return int(value[0])


def fingerprints(docs: DataFrame, keep: list[str], text_column: str = "text",
                 width: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """The columns of keep and fp, the fingerprint as a signed long; for several seeds f0, f1, ..."""
    text, = fresh(docs, "_text")
    slim = docs.select(*keep, text_bytes(text_column).alias(text))
    names = ["fp"] if len(seeds) == 1 else [f"f{i}" for i in range(len(seeds))]
    schema = slim.drop(text).schema
    for name in names:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = rows_of(batch, text)
            values = [pa.array([fingerprint(t, width, seed=s) for t in texts], pa.int64()) for s in seeds]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, *values], names=[*keep, *names])

    return slim.mapInArrow(run, schema)


def _pairs_to(syndrome: int) -> list[tuple[int, int]]:
    """Positions 1..31 to flip in pairs so that a word with this syndrome becomes a code word."""
    return [(a, a ^ syndrome) for a in range(1, 32) if a < a ^ syndrome]


def anchors(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, anchor, whether it is home) for unsigned fingerprints, one array per way to reach one.

    An anchor is a number: bit 32 names the half, bit 31 the free bit, the rest the code word.
    """
    one = np.uint64(1)
    masks = [np.uint64(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)) for k in range(5)]
    for half in (0, 1):
        word = fps >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
        code, tag = word & np.uint64(0x7FFFFFFF), word & np.uint64(0x80000000)
        tag = tag | np.uint64(half << 32)
        syndrome = np.zeros(len(fps), np.uint64)
        for k, mask in enumerate(masks):
            syndrome |= (np.bitwise_count(code & mask).astype(np.uint64) & one) << np.uint64(k)
        near = np.where(syndrome > 0, code ^ (one << (np.maximum(syndrome, one) - one)), code)
        every = np.arange(len(fps))
        yield every, near | tag, True
        yield every, near | (tag ^ np.uint64(0x80000000)), False
        for s in range(1, 32):
            rows = np.flatnonzero(syndrome == s)
            if len(rows):
                for a, b in _pairs_to(s):
                    flip = np.uint64((1 << (a - 1)) | (1 << (b - 1)))
                    yield rows, (code[rows] ^ flip) | tag[rows], False


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(0, len(fps), 1 << 14):
            some = fps[start:start + (1 << 14)]
            found = list(anchors(some))
            if not len(some):
                continue
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([a for _, a, _ in found]).view(np.int64)),
                pa.array(np.concatenate([some[r] for r, _, _ in found]).view(np.int64)),
                pa.array(np.concatenate([np.full(len(r), h) for r, _, h in found]))],
                names=["anchor", "fp", "home"])


def forest(fps: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Links within RADIUS bits between homes and members of one anchor that span its groups."""
    order = np.argsort(~home, kind="stable")  # homes first
    fps, homes = fps[order], int(home.sum())
    free = np.ones(len(fps), bool)
    out = []
    for seed in range(homes):
        if not free[seed]:
            continue
        free[seed] = False
        todo = [seed]
        while todo:
            at = todo.pop()
            reach = len(fps) if at < homes else homes
            rest = np.flatnonzero(free[:reach])
            new = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= RADIUS]
            free[new] = False
            todo.extend(new.tolist())
            out.extend((at, i) for i in new.tolist())
    signed = fps.view(np.int64)
    return [(int(signed[a]), int(signed[b])) for a, b in out]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor and tile; each run of equal ones is compared."""

    def links(key: np.ndarray, fps: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        homes = np.add.reduceat(home.astype(np.int64), starts)
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero((ends - starts > 1) & (homes > 0)):
            s, e = starts[i], ends[i]
            own = fps[s:e]
            if e - s < 64 and not (np.bitwise_count(own[home[s:e]][:, None] ^ own) <= RADIUS).sum() > homes[i]:
                continue
            found += forest(own, home[s:e])
        a, b = ([x[k] for x in found] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                          names=["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        part = (batch.column(0).to_numpy(zero_copy_only=False) * 1_000_003
                + batch.column(1).to_numpy(zero_copy_only=False),
                batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64),
                batch.column(3).to_numpy(zero_copy_only=False))
        if not len(part[0]):
            continue
        held.append(part)
        if part[0][0] == part[0][-1] and held[0][0][0] == part[0][0]:
            continue  # still inside one run
        key, fps, home = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = len(key) - int(np.argmax((key != key[-1])[::-1]))
        yield links(key[:cut], fps[:cut], home[:cut])
        held = [(key[cut:], fps[cut:], home[cut:])]
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints of a frame of distinct ones (fp) that span all groups of
    fingerprints linked at RADIUS bits or fewer."""
    visits = distinct.select("fp").mapInArrow(_visits, "anchor long, fp long, home boolean")
    crowded = stored(visits.where("home").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
                     .where(F.col("n") > TILE)
                     .select("anchor", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")),
                     "crowded-anchors")
    if crowded.isEmpty():
        tiled = visits.withColumn("tile", F.lit(0))
    else:
        tiles = F.coalesce("tiles", F.lit(1))
        own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
        tiled = visits.join(crowded, "anchor", "left").withColumn(
            "tile", F.explode(F.when(F.col("home"), F.array(own))
                              .otherwise(F.sequence(F.lit(0), tiles - 1))))
        others = tiled.where("home AND tiles > 1").withColumn(
            "tile", F.explode(F.filter(F.sequence(F.lit(0), tiles - 1), lambda t: t != F.col("tile")))
        ).withColumn("home", F.lit(False))
        tiled = tiled.unionByName(others)
    return (tiled.select("anchor", "tile", "fp", "home").repartition("anchor", "tile")
            .sortWithinPartitions("anchor", "tile").mapInArrow(_compare, "a long, b long"))


def labelled(fps: DataFrame, root: str = "root") -> DataFrame:
    """fps with the root fingerprint of its group; fps has a column fp."""
    distinct = stored(fps.select("fp").distinct(), "fingerprints")
    roots = stored(components(near_links(distinct)), "roots").select(
        F.col("node").alias("_node"), F.col("root").alias(root))
    return (fps.join(roots, fps.fp == F.col("_node"), "left").drop("_node")
            .withColumn(root, F.coalesce(root, "fp")))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    fps = stored(fingerprints(slim, ["doc_id"], "text", width), "doc-fingerprints")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    by_fp = stored(labelled(firsts), "labelled")
    ids = stored(by_fp.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    of = stored(by_fp.join(ids, "root").select(F.col("fp").alias("_fp"), "component_id"), "of-fp")
    return fps.join(of, fps.fp == F.col("_fp")).select("doc_id", hex_of("fp"), "component_id")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     width: int = 3) -> DataFrame:
    """docs with one document of each component, that with the smallest id (a null id comes last).

    Of documents that share this id the one whose text hashes lowest stays; rows that repeat an id and its
    text are one document. Only groups of two or more give a list of documents to leave out, so texts are read
    for the fingerprint and for the result, and are compared by id and hash."""
    own, digest, left, left_digest = fresh(docs, "_id", "_hash", "_left", "_left_hash")
    hashed = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    slim = docs.select(F.col(id_column).alias("id"), hashed.alias("hash"), F.col(text_column).alias("text"))
    fps = stored(fingerprints(slim, ["id", "hash"], "text", width), "doc-fingerprints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    by_fp = stored(labelled(fps.groupBy("fp").agg(F.min(order).alias("least"), F.max(order).alias("most"))), "labelled")
    groups = (by_fp.groupBy("root").agg(F.min("least").alias("stays"), F.max("most").alias("last"))
              .where(~F.col("stays").eqNullSafe(F.col("last"))))
    members = stored(by_fp.join(groups, "root").select(F.col("fp").alias("_fp"), "stays"), "members")
    out = (fps.join(members, fps.fp == F.col("_fp")).where(~order.eqNullSafe(F.col("stays")))
           .select(F.col("id").alias(left), F.col("hash").alias(left_digest)).distinct())
    return (docs.withColumn(own, F.col(id_column)).withColumn(digest, hashed)
            .join(out, F.col(own).eqNullSafe(F.col(left)) & (F.col(digest) == F.col(left_digest)), "left_anti")
            .select(docs.columns))


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0")).alias("fingerprint")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
SQL: dict[str, str] = {}
