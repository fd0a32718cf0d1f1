import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codelake.llm import simhash
from codelake.llm.components import components


def brute_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = ([b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)]
                or [b" ".join(words)])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, width=3):
    fps = [brute_fingerprint(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    array = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 3):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(simhash.near_duplicates(df)) == brute(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "One two"), (3, "ONE two"), (None, " \t"), (5, "x " * 50_000),
            (6, "a b c d"), (7, None)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    assert got(simhash.near_duplicates(df)) == brute(rows)
    assert simhash.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("tile", [4096, 3])
def test_chains_meet(spark, monkeypatch, tile):
    """Random fingerprints and neighbours of them, against all pairs; also with crowded anchors."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:40]:
        at = int(b)
        for _ in range(6):
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                at ^= 1 << int(bit)
            fps.add(at)
    low = int(base[0])
    fps |= {low ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(64) if i != j}
    fps = np.array(sorted(fps), np.uint64)
    root = {int(f): int(f) for f in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for f in fps:
        for g in fps[np.bitwise_count(fps ^ f) <= 3]:
            a, b = find(int(f.view(np.int64))), find(int(g.view(np.int64)))
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = simhash.near_links(df)
    if tile == 4096:
        assert links.count() < 34 * len(fps)
    out = {r.fp: r.root for r in simhash.labelled(df).collect()}
    assert out == {k: find(k) for k in root}


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    out = {r.node: r.root for r in components(df).collect()}
    assert out == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components(df.where(F.lit(False))).count() == 0


def test_one_document_of_each_group_stays(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = brute([(r.doc_id, r.text) for r in df.collect()])
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in rows})
    text = " ".join(f"w{i}" for i in range(80))
    odd = [(4, text), (2, text), (2, text), (2, "quite another"), (None, text), (None, "alone here"), (9, None), (8, "")]
    frame = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(odd)], "_id long, fp string, _hash int")
    out = sorted(r["_hash"] for r in simhash.drop_near_copies(frame, "_id", "fp").collect())
    assert out == [1, 2, 3, 5, 7]  # rows that repeat id and text are one document
    assert simhash.drop_near_copies(frame.where("false"), "_id", "fp").count() == 0
