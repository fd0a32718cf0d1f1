import hashlib

import pytest
from pyspark.sql import functions as F

from codelake.llm import warc


def test_chunked_framing():
    for payload in (b"", b"x", b"ab\r\n" * 5000):
        assert warc.unchunked(warc.chunked(payload, 7)) == (payload, True)
    assert warc.unchunked(b"4;x=y\r\nWiki\r\n0\r\n\r\n") == (b"Wiki", True)
    assert warc.unchunked(b"9\r\nWiki\r\n") == (b"Wiki\r\n", False)
    assert warc.unchunked(b"zz") == (b"", False)


def rows():
    long = "é\r\n\r\nWARC/1.1\r\n" * 9000
    return [(1, "http://a/1", "x" * 99), (2, "http://a/2", "x" * 99), (3, "http://b/\r\n ", long), (4, None, long),
            (5, "http://c", None), (6, "http://c", ""), (8, "u", "y" * 100), (7, "v", "y" * 100), (7, "v", "y" * 100),
            (None, "w", "y" * 100), (None, None, "z" * 5000), (9, "q", "<html>" + "ü" * 70_000)]


@pytest.mark.parametrize("segment", [64, 32 << 10])
def test_round_trip(spark, tmp_path, segment):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows()], "page_id long, url string, html string, n int, first string")
    out = warc.round_trip(df, str(tmp_path / "warc"), segment)
    want = []
    for d, _, t in rows():
        data = (t or "").encode()
        first = min((x for x, _, y in rows() if y == t and x is not None), default=None)
        again = len(data) >= 100 and d != first
        want.append((d, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                     first if again else None, True))
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
    records = warc.read_warc(spark, str(tmp_path / "warc"))
    assert records.agg(F.max(F.octet_length("block"))).first()[0] <= segment or segment == 32 << 10


def test_broken_groups_are_told(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc" * 500), (2, "u", "d" * 1500)], "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"), 300)
    records = warc.read_warc(spark, str(tmp_path / "w"))
    whole = warc.reassemble(records)
    assert {(r.page, r.complete, len(r.payload)) for r in whole.collect()} == {("1", True, 1500), ("2", True, 1500)}
    lost = warc.reassemble(records.where("NOT (page = '1' AND coalesce(number, '') = '3')"))
    assert {(r.page, r.complete) for r in lost.collect()} == {("1", False), ("2", True)}
    orphan = warc.reassemble(records.where("NOT (page = '2' AND coalesce(number, '') = '1')"))
    assert sorted(r.complete for r in orphan.collect()) == [False, True]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df, str(tmp_path / "none")).count() == 0
