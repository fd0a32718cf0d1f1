import hashlib

import numpy as np
import pytest

from codelake.llm import repeats


def brute(rows):
    """Every window of every document, in order of id and start."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    first, out = {}, {}
    for i in order:
        d, t = rows[i]
        for p in range(len(t) - 99):
            first.setdefault(t[p:p + 100], (d, p))
    for i, (d, t) in enumerate(rows):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            if first[t[p:p + 100]] != (d, p):
                gone[p:p + 100] = True
        spans = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (str(d), len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values())


def got(df, **more):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in repeats.remove_repeats(df, **more).collect())


@pytest.mark.parametrize("size", [repeats.CHUNK, 40_000])
def test_documents(spark, size):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text.encode()) for r in df.collect()]
    assert got(df, chunk_bytes=size) == brute(rows)


@pytest.mark.parametrize("block", [1 << 20, 1 << 11])
def test_planted_passages(spark, monkeypatch, block):
    """Shared passages with equal, partly equal and different surroundings, runs and periods."""
    monkeypatch.setattr(repeats, "BLOCK", block)
    repeats.Hasher._power = None
    rng = np.random.default_rng(block)

    def noise(n):
        return bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()

    shared = [noise(int(n)) for n in rng.integers(60, 400, 6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            s = shared[int(rng.integers(6))]
            a, b = sorted(rng.integers(0, len(s) + 1, 2))
            parts += [noise(int(rng.integers(0, 150))), s if rng.random() < 0.5 else s[a:b]]
        rows.append((int(rng.integers(0, 10**6)) * 100 + i, "".join(parts)))
    rows += [(5, "ab" * 400), (6, "a" * 99), (7, "a" * 100), (8, "a" * 1000), (9, "ab" * 60 + "x" + "ab" * 80),
             (-3, shared[0] + noise(5000) + shared[0]), (10, "é" * 50), (11, "é" * 51)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, chunk_bytes=6000) == brute([(d, t.encode()) for d, t in rows])
    repeats.Hasher._power = None


def test_edge_rows(spark):
    text = "".join(map(str, range(100)))
    rows = [(None, text), (1, text), (1, text), (2, None), (3, ""), (4, text + text)]
    df = spark.createDataFrame([(d, t, 5, 6) for d, t in rows], "doc_id long, text string, chunk int, part int")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n = len(text)
    assert got(df) == sorted([("None", n, 0, 0, sha(text)), ("1", n, n, 1, sha("")), ("1", n, n, 1, sha("")),
                              ("2", 0, 0, 0, sha("")), ("3", 0, 0, 0, sha("")),
                              ("4", 2 * n, 2 * n - 99 * 0 - kept(text), 1 if kept(text) == 0 else 2,
                               sha(rest(text)))])
    assert repeats.remove_repeats(df.where("false")).count() == 0


def rest(text):
    """What is left of text + text after text was seen: nothing but bytes no repeated window covers."""
    both, gone = text + text, set()
    seen = {text[p:p + 100] for p in range(len(text) - 99)}
    for p in range(len(both) - 99):
        if both[p:p + 100] in seen:
            gone |= set(range(p, p + 100))
        seen.add(both[p:p + 100])
    return "".join(c for i, c in enumerate(both) if i not in gone)


def kept(text):
    return len(rest(text))
