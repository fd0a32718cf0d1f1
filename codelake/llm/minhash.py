"""MinHash near-dedup by an inverted join of signature coordinates.

A document is the set of its distinct word shingles, as 64-bit hashes; documents with equal sets are one
class. Sets are stored with the upper 48 bits of each hash. A class has a signature of COORDINATES minima. Its postings are the pairs (coordinate, value), each
a token; two classes whose signatures agree in MATCHES places share that many tokens.

Prefix: tokens are ordered by how many classes hold them, rarest first. Of two classes that share MATCHES
tokens, one shared token is among the first COORDINATES - MATCHES + 1 of both, so only those are posted;
the frequent tokens of common passages stay out. Skip: a token that one class alone holds can't collide,
and a class with fewer than MATCHES tokens that others hold has no partner; both drop out before
anything is compared. A posting list counts the collisions of its members over their whole signatures (one
byte a coordinate) and keeps those with MATCHES or more. MATCHES is set so that a pair at the limit of
similarity falls below it with a chance of about one in a hundred thousand.

What a list passes on spans its groups and is linear in its members. The groups these pairs form bring
together the full sets, from a second reading of the texts: within a group, pairs are taken by falling count, those already in one component
are skipped, and a link is the exact share of the sets. Again only links that join components come out.

Large lists and groups are cut into tiles. In a first round each tile links its own members, and a
few pivots visit every tile, so that a group of copies grows together across its tiles. In a second
round the members outside the largest component of the list visit all tiles; pairs inside that component
need nothing more. So every pair that might join two components is compared, and copies cost no pairs.

Edge cases: a text with fewer words than a shingle is one shingle, the whole sequence; a text without
words (or null) has the empty set and links with nothing, not even with other empty ones. A null id is
ignored when the smallest id of a component is looked for; a component of null ids has a null id and keeps
all its rows. Rows that share an id are documents of their own: each has its own set and component, and
all rows of an id that stays are kept. An empty table gives an empty result. Other columns are ignored and
may have any name. Long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from codelake.llm.common import rows_of, ship, sliced, stored, table, text_bytes
from codelake.llm.components import components

ship(__name__)

WORDS = 5  # of a shingle
COORDINATES = 48
MATCHES = 29  # a pair at 0.85 has fewer with a chance of 1e-5
LIMIT = 85  # per cent of the union
TILE = 4096  # members of a tile
TILE_HASHES = 1 << 21  # hashes of a tile
KEPT = 6  # bytes kept of a hash in a stored set: of two sets of 400, one pair in 10 ** 9 seems to share one more
PIVOTS = 64
_SEEDS = np.random.Generator(np.random.PCG64(20_241)).integers(1, 1 << 63, (2, COORDINATES), np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, width: int = WORDS) -> np.ndarray:
    """Distinct shingles of a text as sorted 64-bit hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    run = min(width, len(words))
    out = np.full(n, run, np.uint64)
    for i in range(run):  # depends on the order of the words
        out = _spread(out * _MIX + hashed[i:i + n])
    return np.unique(out)


def packed(hashes: np.ndarray) -> bytes:
    """A sorted set without the low bytes of its hashes."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT:].tobytes()


def digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def unpacked(data: pa.Buffer) -> np.ndarray:
    high = np.frombuffer(data, np.uint8).reshape(-1, KEPT)
    out = np.zeros((len(high), 8), np.uint8)
    out[:, 8 - KEPT:] = high
    return out.view("<u8")[:, 0]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima for each set (not empty)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for i, (a, b) in enumerate(_SEEDS.T):
        mixed = (flat ^ a) * b
        out[:, i] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)
    return out


def described(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
              width: int = WORDS) -> DataFrame:
    """row, doc_id, n_shingles and, for documents with words, digest, tokens, sketch."""
    slim = docs.select(F.col(id_column).alias("doc_id"), text_bytes(text_column).alias("text"))
    schema = slim.select("doc_id").schema
    for name, kind in (("n_shingles", LongType()), ("digest", BinaryType()), ("tokens", ArrayType(LongType())),
                       ("sketch", BinaryType())):
        schema = schema.add(name, kind)
    places = np.arange(1, COORDINATES + 1, dtype=np.uint64) * _MIX

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            sets = [shingle_set(t, width) for t in rows_of(batch, "text")]
            some = [s for s in sets if len(s)]
            minima = signatures(some) if some else np.zeros((0, COORDINATES), np.uint64)
            tokens = _spread(minima ^ places)
            at, lists = 0, ([], [])
            for s in sets:
                lists[0].append(tokens[at].view(np.int64) if len(s) else None)
                lists[1].append((minima[at] >> np.uint64(7)).astype(np.uint8).tobytes() if len(s) else None)
                at += bool(len(s))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array(lists[0], pa.list_(pa.int64())), pa.array(lists[1], pa.binary())],
                names=["doc_id", "n_shingles", "digest", "tokens", "sketch"])

    return slim.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def full_sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """wanted (node, of_id, of_digest, ...) with the hashes of each node, from a second reading of the texts: only
    sets that have a possible partner are worth keeping, so none is stored before that is known."""
    slim = docs.select(F.col(id_column).alias("doc_id"), text_bytes(text_column).alias("text"))
    schema = slim.select("doc_id").schema.add("digest", BinaryType()).add("hashes", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            sets = [shingle_set(t, width) for t in rows_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([packed(s) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "digest", "hashes"])

    same = (F.col("digest") == F.col("of_digest")) & F.col("doc_id").eqNullSafe(F.col("of_id"))
    return (slim.mapInArrow(run, schema).join(wanted, same).drop("doc_id", "digest", "of_id", "of_digest")
            .dropDuplicates(["node"]))


def prefixes(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """node, sketch, token, n: the tokens to post for each class (node, tokens, sketch), and how many
    classes hold each."""
    tokens = classes.select("node", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = (tokens.join(shared, "token").groupBy("node")
            .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))  # COORDINATES at most
            .where(F.size("held") >= matches)
            .withColumn("held", F.expr(f"slice(held, 1, size(held) - {matches - 1})")))
    return (classes.select("node", "sketch").join(held, "node")
            .select("node", "sketch", F.explode("held").alias("held"))
            .select("node", "sketch", "held.token", "held.n"))


# Comparing the members of a tile


class _Members:
    """Members of a tile: nodes, components as far as known, sketches, and full sets or None."""

    def __init__(self, node: np.ndarray, comp: np.ndarray, sketch: np.ndarray, sets: list | None):
        self.node, self.comp, self.sketch, self.sets = node, comp.copy(), sketch, sets
        if sets is not None:
            self.size = np.array([len(s) for s in sets], np.int64)


def _counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coordinates in which each row of a agrees with each row of b."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        out += a[:, k][:, None] == b[:, k]
    return out


def _linked(left: _Members, right: _Members, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Whether left[i] and right[j] are linked, exactly where sets are given."""
    if left.sets is None:
        return np.ones(len(i), bool)
    out = np.zeros(len(i), bool)
    a, b = left.size[i], right.size[j]
    fit = np.flatnonzero(100 * np.minimum(a, b) >= limit * np.maximum(a, b))
    fit = fit[np.argsort(i[fit], kind="stable")]
    for own in np.split(fit, np.flatnonzero(np.diff(i[fit])) + 1) if len(fit) else []:
        base = left.sets[i[own[0]]]
        others = [right.sets[x] for x in j[own]]
        flat = np.concatenate(others)
        place = np.minimum(np.searchsorted(base, flat), len(base) - 1)
        both = np.add.reduceat((base[place] == flat).astype(np.int64), np.cumsum([0] + [len(o) for o in others[:-1]]))
        out[own] = 100 * both >= limit * (a[own] + b[own] - both)
    return out


def _joins(left: _Members, right: _Members, matches: int, limit: int) -> Iterator[tuple[int, int]]:
    """Links between left and right that join two components, by falling count of matches."""
    same = left is right
    for start in range(0, len(left.node), 128):
        counts = _counts(left.sketch[start:start + 128], right.sketch)
        open_pairs = (counts >= matches) & (left.comp[start:start + 128][:, None] != right.comp)
        if same:
            open_pairs &= np.arange(start, start + len(counts))[:, None] < np.arange(len(right.node))
        at_i, at_j = np.nonzero(open_pairs)
        level = counts[at_i, at_j]
        for count in np.unique(level)[::-1]:
            some = level == count
            i, j, take = at_i[some] + start, at_j[some], 1
            while True:
                apart = left.comp[i] != right.comp[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    break
                # a few pairs of each two components at a time, twice as many after each failure
                order = np.lexsort((right.comp[j], left.comp[i]))
                i, j = i[order], j[order]
                new = np.concatenate([[True], (np.diff(left.comp[i]) != 0) | (np.diff(right.comp[j]) != 0)])
                rank = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
                now = rank < take
                for x in np.flatnonzero(now)[_linked(left, right, i[now], j[now], limit)]:
                    a, b = left.comp[i[x]], right.comp[j[x]]
                    if a != b:
                        yield int(left.node[i[x]]), int(right.node[j[x]])
                        left.comp[left.comp == b] = a
                        right.comp[right.comp == b] = a
                i, j, take = i[~now], j[~now], take * 2


def _compare(matches: int, limit: int, with_sets: bool) -> Callable:
    """Rows (key, tile, home, node, comp, sketch, hashes) come sorted by key and tile, homes first."""

    def members(rows: list[pa.RecordBatch]) -> _Members:
        whole = pa.Table.from_batches(rows)
        numbers = [whole[c].to_numpy() for c in ("node", "comp")]
        sketch = np.frombuffer(b"".join(whole["sketch"].to_pylist()), np.uint8).reshape(len(numbers[0]), -1)
        sets = [unpacked(s.as_buffer()) for s in whole["hashes"]] if with_sets else None
        return _Members(*numbers, sketch, sets)

    def pairs_only(batch: pa.RecordBatch, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of two rows, all at once."""
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        node = batch.column("node").to_numpy(zero_copy_only=False)
        hit = (sketch[first] == sketch[last]).sum(axis=1) >= matches
        yield from zip(node[first[hit]].tolist(), node[last[hit]].tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, homes = None, [], None
        found: list[tuple[int, int]] = []

        def settle(guests: bool = False) -> None:
            """All homes of the run are here; without guests, one home alone has nobody to meet."""
            nonlocal waiting, homes
            if homes is None and (guests and waiting or sum(w.num_rows for w in waiting) > 1):
                homes = members(waiting)
                if first_round:
                    found.extend(_joins(homes, homes, matches, limit))
            waiting = []

        def out() -> pa.RecordBatch:
            a, b = ([x[k] for x in found] for k in (0, 1))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "tile")])
            home = batch.column("home").to_numpy(zero_copy_only=False)
            first_round = batch.column("first")[0].as_py()
            starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            ends = np.append(starts[1:], batch.num_rows)
            inner = (starts > 0) & (ends < batch.num_rows)
            short = inner & (ends - starts == 2) if not with_sets and first_round else np.zeros(len(starts), bool)
            if short.any():
                found.extend(pairs_only(batch, starts[short], starts[short] + 1))
            for s, e in zip(starts[~short], ends[~short], strict=True):
                if (keys[0, s], keys[1, s]) != key:
                    settle()
                    key, homes = (keys[0, s], keys[1, s]), None
                own = int(home[s:e].sum())  # homes come first
                if own:
                    waiting.append(batch.slice(s, own))
                if own < e - s:
                    settle(True)
                    if homes is not None:
                        guests = members([batch.slice(s + own, e - s - own)])
                        found.extend(_joins(guests, homes, matches, limit))
            yield out()
        settle()
        yield out()

    return run


def spanning_links(members: DataFrame, tiles: Column, share: Column, matches: int, limit: int,
                   with_sets: bool) -> DataFrame:
    """Links (a, b) that span the linked groups of every key.

    members: key, node, sketch, hashes; tiles: into how many tiles its key is cut; share: the share of a
    key's members that a pivot stands for."""
    marked = members.withColumn("tiles", tiles).withColumn("share", share)
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    all_tiles = F.sequence(F.lit(0), F.col("tiles").cast("int") - 1)

    def links(rows: DataFrame, guest: Column, first: bool) -> DataFrame:
        dealt = rows.withColumn("own", own).withColumn(
            "tile", F.explode(F.when((F.col("tiles") > 1) & guest, all_tiles).otherwise(F.array("own"))))
        return (dealt.select("key", "tile", (F.col("tile") == F.col("own")).alias("home"), "node", "comp", "sketch",
                             "hashes", F.lit(first).alias("first"))
                .repartition("key", "tile").sortWithinPartitions("key", "tile", F.desc("home"))
                .mapInArrow(_compare(matches, limit, with_sets), "a long, b long"))

    pivot = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    found = stored(links(marked.withColumn("comp", F.col("node")), pivot, True).distinct(), "links")
    crowded = marked.where("tiles > 1")
    if crowded.isEmpty():
        return found
    known = stored(components(found), "grown").select("node", F.col("root"))
    crowd = stored(crowded.join(known, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"),
                   "crowded")
    main = (crowd.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
            .agg(F.max_by("comp", F.struct("n", "comp")).alias("main")))
    rest = F.col("comp") != F.col("main")
    return found.unionByName(links(crowd.join(main, "key"), rest, False)).distinct()


def links(described_rows: DataFrame, classes: DataFrame, sets: Callable[[DataFrame], DataFrame],
          matches: int = MATCHES, limit: int = LIMIT, tile: int = TILE, tile_hashes: int = TILE_HASHES) -> DataFrame:
    """Exact links (a, b) between classes that span all groups; sets adds the hashes to wanted rows."""
    members = described_rows.join(classes.select("node"), F.col("row") == F.col("node"), "left_semi")
    posted = stored(prefixes(members.select(F.col("row").alias("node"), "tokens", "sketch"), matches), "postings")
    no_sets = posted.select(F.col("token").alias("key"), "node", "sketch", F.lit(None).cast("binary").alias("hashes"), "n")
    near = spanning_links(no_sets, F.ceil(F.col("n") / tile), F.lit(float(PIVOTS)) / F.col("n"), matches, limit, False)
    groups = stored(components(near), "groups")
    weight = F.greatest(F.col("n_shingles"), F.lit(tile_hashes // tile))
    wanted = stored(described_rows.join(groups, F.col("row") == F.col("node")).select(
        F.col("root").alias("key"), "node", "sketch", weight.alias("weight"), F.col("doc_id").alias("of_id"),
        F.col("digest").alias("of_digest")), "wanted-sets")
    full = stored(sets(wanted), "grouped-sets")
    large = stored(full.groupBy("key").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("members"))
                   .where(F.col("total") > tile_hashes)
                   .select("key", F.ceil(F.col("total") / tile_hashes).alias("parts"), "members"), "large-groups")
    sized = full.withColumn("parts", F.lit(1)).withColumn("members", F.lit(1)) if large.isEmpty() else full.join(
        large, "key", "left")
    return spanning_links(sized.drop("weight"), F.coalesce("parts", F.lit(1)),
                          F.lit(float(PIVOTS)) / F.coalesce("members", F.lit(1)), matches, limit, True)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WORDS,
                    **options: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = stored(described(docs, id_column, text_column, width), "shingle-sets")
    classes = stored(rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least")), "classes")

    def sets(wanted: DataFrame) -> DataFrame:
        return full_sets(docs, wanted, id_column, text_column, width)

    roots = stored(components(links(rows, classes, sets, **options)), "roots").withColumnRenamed("node", "_node")
    rooted = stored(classes.join(roots, F.col("node") == F.col("_node"), "left").select(
        "digest", "least", F.coalesce("root", "node").alias("root")), "rooted")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(rooted.join(firsts, "root").select(F.col("digest").alias("_digest"), "component_id"), "of-class")
    some = rows.where("digest IS NOT NULL").join(of, F.col("digest") == F.col("_digest"))
    none = rows.where("digest IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return some.select(columns).unionByName(none.select(columns)).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op12_minhash": op12_minhash}
SQL: dict[str, str] = {}
