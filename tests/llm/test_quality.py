import numpy as np
import zlib

from codelake.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op3_quality(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert len(out) == 1000 and out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.5)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(out.doc_id, out.held_out))
    held = out.merge(labels, on="doc_id").query("held_out")
    good, bad = held[held.quality == 1].score.values, held[held.quality == 0].score.values
    assert (good[:, None] > bad).mean() > 0.97
    assert (held.predicted == held.quality).mean() > 0.95


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(2)
    x, n = np.arange(40.0), rng.integers(1, 9, 40).astype(float)
    y = np.clip(x / 40 + rng.normal(0, 0.3, 40), 0, 1)
    at, level = quality.isotonic(x, y, n)
    assert (np.diff(level) > 0).all() and (np.diff(at) > 0).all()
    # Each level is the minimum over ends of the maximum over starts of means.
    for i in range(40):
        best = min(max(np.average(y[a:b + 1], weights=n[a:b + 1]) for a in range(i + 1)) for b in range(i, 40))
        assert any(abs(best - v) < 1e-9 for v in level)


def test_edge_rows(spark):
    words = "of the and a to in is that it was for on are as with his they at be this from".split()
    rows = [(i, " ".join(words[i % 7:i % 7 + 12]) + ".", 1) if i % 3 else (i, "#$% " * 20, 0) for i in range(90)]
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows]
                                 + [(None, None, "x"), (200, "", "x"), (200, "a " * 100_000, None), (5, "again", "x")],
                                 "doc_id long, text string, vector string")
    labels = spark.createDataFrame([(d, q, 1) for d, _, q in rows] + [(None, 1, 1), (1, None, 1), (7, 0, 0), (999, 1, 1)],
                                   "doc_id long, quality int, label int")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == len(rows) + 4 and all(0 <= r.score <= 1 for r in out)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows) + 4
    none = quality.quality_scores(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    one = quality.quality_scores(docs, labels.where("quality = 1")).collect()
    assert all(r.score > 0.9 for r in one)
    assert quality.quality_scores(docs.where("false"), labels).count() == 0
    assert quality.keep_good(docs.where("false"), labels).count() == 0
