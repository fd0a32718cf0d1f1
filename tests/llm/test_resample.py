import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codelake.llm import resample as rs
from codelake.llm.common import table

SF = "/root/testdata/sf0.001"


def runs(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return [b" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def brute(rows, target):
    """doc_id -> rows of (n_features, weight, score, rank)."""
    own = [[zlib.crc32(f) % 10_000 for f in runs(t)[0]] for _, t in rows]
    s, t = Counter(b for x in own for b in x), Counter(zlib.crc32(f) % 10_000 for x in target for f in runs(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000.0) / ((s[b] + 1.0) * (all_t + 10_000.0))))
            for b in range(10_000)]
    out = []
    for (doc, text), buckets in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(buckets), weight, score, None, runs(text)[1]])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(fit[:5 * len(fit) // 100], 1):
        r[4] = rank
    return sorted(out, key=str)


def got(df):
    return sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"], r.n_words] for r in df.collect()), key=str)


@pytest.mark.parametrize("piece", [7, 100, 1 << 18])
def test_crc_of_every_feature(monkeypatch, piece):
    monkeypatch.setattr(rs, "PIECE", piece)
    rng = random.Random(5)
    texts = ["", "...", "one", "Two words", " a  b\tc é一二三 ", "x" * 1000 + " y " + "z" * 129 + " w" * 5, "一" * 777 + " b"]
    texts += ["".join(rng.choice("abc XYZ09-\né") for _ in range(rng.randrange(900))) for _ in range(30)]
    texts += [f"{'q' * n} {'r' * (n // 2 + 1)} t" for n in (1, 63, 64, 65, 127, 128, 129, 191, 192, 193, 4095, 4097)]
    found = [[] for _ in texts]
    for text, crcs in rs.features([t.encode() for t in texts]):
        for a, b in zip(text, crcs, strict=True):
            found[a].append(int(b))
    for t, f in zip(texts, found, strict=True):
        assert sorted(f) == sorted(zlib.crc32(x) for x in runs(t)[0])


def test_length_constants():
    lengths = np.array([0, 1, 63, 64, 65, 4095, 4096, 70_001])
    assert rs.length_constants(lengths).tolist() == [zlib.crc32(bytes(int(n))) for n in lengths]


def test_documents(spark):
    docs = table(spark, SF, "documents")
    target = [r.text for r in table(spark, SF, "benchmark").collect()]
    out = rs.op11_resampling(spark, SF)
    assert out.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert [t for _, t in out.dtypes[:5]] == ["bigint"] * 5
    assert got(out) == brute([(r.doc_id, r.text) for r in docs.collect()], target)


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(rs, "HELD", 300)
    words = [f"w{i % 37}" for i in range(90)]
    rows = [(i, " ".join(words[i % 40:i % 40 + 22])) for i in range(120)]
    rows += [(5, rows[5][1])] * 30 + [(None, rows[7][1]), (None, None), (500, None), (501, ""), (502, "!? .."),
                                      (503, " ".join(words[:19])), (504, " ".join(words[:20])), (505, "v" * 5000),
                                      (506, "long " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    goal = spark.createDataFrame([(None, 1), ("", 2), ("w3 w4 w5 w6", 3), ("w3 w4", 3)], "text string, n int")
    want = brute(rows, [r.text for r in goal.collect()])
    assert got(rs.resample(df, goal)) == want
    assert got(rs.resample(df.repartition(5), goal.repartition(2))) == want
    odd = df.withColumnRenamed("text", "_at").withColumnRenamed("doc_id", "score").selectExpr("*", "1 AS doc_id", "2 AS rank", "3 AS text")
    assert got(rs.resample(odd, goal.withColumnRenamed("text", "bucket"), id_column="score", text_column="_at", target_column="bucket")) == want
    assert rs.resample(df.where("false"), goal).count() == 0
    assert got(rs.resample(df, goal.where("false"))) == brute(rows, [])
    drawn = rs.drawn_documents(df, goal).collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, 1 + 5 * sum(len((t or "").split()) >= 20 for _, t in rows) // 100))
