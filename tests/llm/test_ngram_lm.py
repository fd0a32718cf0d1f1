import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codelake.llm import ngram_lm


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()) + [None]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7


def brute(rows):
    """Base scores, and counts for the model."""
    train = [words(t) for d, t in rows if fold(d) != 2]
    uni = Counter(w for ws in train for w in ws)
    n, v = sum(uni.values()), len(uni)
    pair = Counter(p for ws in train for p in zip([None, *ws], ws))
    return uni, n, v, pair


@pytest.mark.parametrize("size", [1 << 24, 60_000])
def test_against_brute_force(spark, size):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(None, None), (5, ""), (5, ""), (901, "the The THE"), (902, "\t\n zzz-new-word \x0b"),
             (903, "a " * 40_000), (904, "x" * 70_000)]
    df = df.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [tuple(r) for r in df.collect()]
    uni, n, v, pair = brute(rows)
    out = ngram_lm.score_documents(df.selectExpr("doc_id", "text", "1 AS chunk", "2 AS role"), chunk_bytes=size)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                 for r in out.collect())
    want = sorted((str(d), fold(d) == 2, len(words(t)), sum(uni[w] > 0 for w in words(t)), n,
                   round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-4)
    assert all(r.score < 0 for r in out.collect())


def test_weights_make_a_distribution_and_beat_the_base(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = [r for r in ngram_lm.score_documents(df).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_learned_weights_maximise_the_likelihood():
    rng = np.random.default_rng(0)
    grid = np.array([[b, rng.integers(0, 200), rng.integers(1, 200), rng.integers(1, 50)]
                     for b in (0, 3, 5) for _ in range(50)], float)
    grid[:50, 1] = 0
    weights = ngram_lm.learned(grid)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all()

    def likelihood(w, b):
        own = grid[grid[:, 0] == b]
        parts = np.ones((len(own), 3))
        for k in (0, 1):
            parts[:, k] = np.where(own[:, 1 + k] > 0, 2.0 ** ((own[:, 1 + k] - 128) / 4), 0)
        return (own[:, 3] * np.log(parts @ w)).sum()
    for b in (3, 5):
        best = likelihood(weights[b], b)
        for _ in range(200):
            assert likelihood(rng.dirichlet([1, 1, 1]), b) <= best + 1e-2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_lm.score_documents(df).count() == 0
