import hashlib

import pytest

from codelake.llm import exact

ROWS = [(1, "a"), (2, None), (3, ""), (4, "a"), (4, "a"), (5, "A"), (None, "a"), (None, "z"),
        (6, "x" * 300_000), (7, "x" * 300_000), (8, "x" * 299_999)]


@pytest.mark.parametrize("limit", [256 << 20, 0])
def test_report_and_filter(spark, limit):
    df = spark.createDataFrame([(d, t, "s") for d, t in ROWS], "doc_id long, text string, _maybe string")
    out = exact.duplicate_report(df, max_filter_bytes=limit)
    want = []
    for d, t in ROWS:
        ids = [x for x, y in ROWS if (y or "") == (t or "")]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    key = repr
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)
    kept = exact.drop_copies(df, max_filter_bytes=limit)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, (r.text or "")[:3], len(r.text or "")) for r in kept.collect()), key=key) == \
        sorted([(3, "", 0), (4, "a", 1), (5, "A", 1), (None, "z", 1), (7, "xxx", 300_000),
                (8, "xxx", 299_999)], key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact.duplicate_report(df).count() == 0
    assert exact.drop_copies(df).count() == 0


def test_filter_lets_most_rows_pass(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    flagged = exact.flagged(df, df.text, "maybe", 16, 2, 1 << 20)
    assert flagged.where("maybe").count() < 400
