import random

import numpy as np
import pytest

from codelake.llm import minhash as mh
from codelake.llm.common import table

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, limit=85):
    """Rows (doc_id, n_shingles, component_id, kept) by comparing all distinct sets."""
    sets = [shingles(t) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=lambda s: (len(s), sorted(s)))
    parent = list(range(len(distinct)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            if len(b) * 100 >= limit * len(a) and 100 * len(a & b) >= limit * len(a | b):
                parent[find(i)] = find(j)
    of = {s: find(i) for i, s in enumerate(distinct)}
    least = {}
    for (doc, _), s in zip(rows, sets, strict=True):
        if s and doc is not None:
            least[of[s]] = min(doc, least.get(of[s], doc))
    out = []
    for (doc, _), s in zip(rows, sets, strict=True):
        component = least.get(of[s]) if s else doc
        out.append((doc, len(s), component, doc == component))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def family(rng, n, words=60, edits=2):
    """Texts, each a copy of an earlier one with a few words changed."""
    texts = [[rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(words)]]
    while len(texts) < n:
        new = list(rng.choice(texts))
        for _ in range(rng.randrange(edits + 1)):
            new[rng.randrange(words)] = str(rng.randrange(10**6))
        texts.append(new)
    return [" ".join(t) for t in texts]


def test_documents(spark):
    docs = table(spark, SF, "documents")
    out = mh.op12_minhash(spark, SF)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(out) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("options", [{}, {"tile": 8, "tile_hashes": 8 * 60}])
def test_families_and_common_passages(spark, options, monkeypatch):
    monkeypatch.setattr(mh, "PIVOTS", 4)
    rng = random.Random(11)
    passage = " ".join(f"common{i}" for i in range(30))
    texts = family(rng, 90, edits=1) + family(rng, 60, edits=4) + family(rng, 25, words=300, edits=9)
    texts += [passage + " " + " ".join(str(rng.randrange(10**6)) for _ in range(40)) for _ in range(60)]
    texts += [passage + f" end{i}" for i in range(12)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({r[2] for r in want}) < len(rows) - 80  # the families hang together
    assert got(mh.near_duplicates(df, **options)) == want
    assert got(mh.near_duplicates(df.repartition(6), **options)) == want


def test_edge_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    near = text.replace("w100", "other")
    rows = [(3, text), (9, near), (9, near), (4, "A b  C\td"), (2, "a b c d"), (7, "a b c"), (8, "A B C"), (10, None),
            (11, ""), (11, " \n"), (None, ""), (None, text.upper()), (None, "all alone here with null id"),
            (None, "all alone here with null id"), (12, "v " * 50_000), (13, "v v v v v v"), (14, "é É é É é"),
            (15, "É é é É é"), (3, "another text of the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(mh.near_duplicates(df)) == sorted(
        [r if r[0] is not None or r[2] is not None else (None, r[1], None, True) for r in brute(rows)], key=str)
    odd = df.withColumnRenamed("text", "row").withColumnRenamed("doc_id", "digest").selectExpr("*", "1 AS node", "2 AS text")
    assert got(mh.near_duplicates(odd, "digest", "row")) == got(mh.near_duplicates(df))
    assert mh.near_duplicates(df.where("false")).count() == 0
    named = spark.createDataFrame([("b", text), ("a", near), ("c", "x")], "doc_id string, text string")
    assert got(mh.near_duplicates(named)) == [("a", 196, "a", True), ("b", 196, "a", False), ("c", 1, "c", True)]


def test_pairs_at_the_limit_have_enough_matches():
    rng = np.random.default_rng(3)
    short = 0
    for _ in range(300):
        common = rng.integers(0, 1 << 63, 85, np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n, np.uint64)])) for n in (8, 7))
        x, y = mh.signatures([a, b])
        short += (x == y).sum() < mh.MATCHES
    assert short == 0
