import os
import sys

import pytest

from codelake.llm import decontaminate, quality
from codelake.llm.common import table
from tests_llm_helpers import linked_groups

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF)
        if len(out) < 4:
            assert kept.columns == docs.columns
            kept = spark.createDataFrame(kept.collect(), kept.schema)
        out.append((docs.collect(), kept.collect()))
        docs = kept
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_quality_stage(spark, steps):
    before, after = steps[0]
    scores = quality.quality_scores(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert ids(after) == ids(r for r in scores.collect() if r.predicted == 1)
    good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
    assert len(good & set(ids(after))) >= 0.97 * len(good & set(ids(before)))


def test_exact_stage(steps):
    before, after = steps[1]
    last = {}
    for r in before:
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    assert ids(after) == sorted(last.values())


def test_near_stage(steps):
    before, after = steps[2]
    groups = linked_groups([(r.doc_id, r.text) for r in before], 3, (42,), 3)
    assert ids(after) == sorted(min(before[i].doc_id for i in g) for g in groups)


def test_benchmark_stage(spark, steps):
    before, after = steps[3]
    items = [decontaminate.words_of(r.text) for r in table(spark, SF, "benchmark").collect()]
    dirty = {r.doc_id for r in before for x in items if " ".join(x) in " ".join(decontaminate.words_of(r.text))}
    assert dirty and not dirty & set(ids(after))
    assert len(after) >= len(before) - 3 * len(dirty)


def test_mixing_stage_and_run(spark, steps):
    before, after = steps[4]
    assert all(r.mix.copies >= 1 and r.mix.taken == r.mix.copies * r.mix.size for r in after)
    goals = {}
    for r in after:
        goal, taken = goals.get(r.source, (r.mix.target, 0))
        goals[r.source] = goal, taken + r.mix.taken
    longest = max(r.mix.size for r in after)
    assert all(abs(goal - taken) <= longest for goal, taken in goals.values())
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.mix.copies) for r in out) == sorted((r.doc_id, r.mix.copies) for r in after)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, mix int, _id string"


def folder(spark, path, docs, benchmark, labels):
    for name, rows, schema in (("documents", docs, DOCS), ("benchmark", benchmark, "item_id long, text string"),
                               ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_run_on_awkward_rows(spark, tmp_path):
    good = [" ".join(f"sound{(i * 7 + j * j) % 211} prose" for j in range(60)) for i in range(30)]
    rows = [(i, t, "en", "ab"[i % 2], 1, 0, "x") for i, t in enumerate(good)]
    rows += [(100, None, None, None, None, None, None), (101, "", None, None, None, None, None),
             (None, good[3] + " and more", "en", "a", 1, 0, "x"), (5, good[5], "en", "b", 1, 9, "y"),
             (102, "leak " + "one two three four five six seven eight nine ten", "en", "b", 1, 0, "x"),
             (103, good[0] + " long" * 30_000, "en", "c", 1, 0, "x")]
    item = [(1, "one two three four five six seven eight nine ten"), (2, None), (3, "")]
    sf = folder(spark, tmp_path, rows, item, [])
    out = corpus_pipeline.run(spark, sf).collect()
    assert out[0].__fields__[:7] == ["doc_id", "text", "lang", "source", "n_chars", "mix", "_id"]
    assert out[0].__fields__[7] == "mix_"
    kept = [r.doc_id for r in out]
    assert 102 not in kept and kept.count(5) <= 1 and len(set(kept)) == len(kept)
    texts = [r.text or "" for r in out]
    assert len(set(texts)) == len(texts)


def test_run_on_empty_tables(spark, tmp_path):
    one = [(1, "a few words that stay", "en", "a", 1, 0, "x")]
    none = folder(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, none).count() == 0
    bare = folder(spark, tmp_path / "bare", one, [], [])
    assert [r.doc_id for r in corpus_pipeline.run(spark, bare).collect()] == [1]
