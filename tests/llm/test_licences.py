from codelake.llm import licences


def test_equal_texts_in_other_clothes(spark):
    isc = dict(licences.NOTICES)["ISC"]
    clothes = "Copyright (c) 2020 Somebody\n\n" + isc.upper().replace(" ", "  ").replace('"', "“")
    rows = [(1, isc), (2, clothes), (3, isc + " more"), (4, None), (5, ""), (6, "Released under the MIT licence"),
            (7, "text\n  RELEASED under the MIT License!\nmore\nLicensed under CC BY-NC 4.0\nReleased under the MIT License."),
            (7, "(c) me"), (8, "word " * 200_000), (None, isc)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows],
                                 "doc_id long, text string, digest string, row int")
    known = licences.known_digests(spark.createDataFrame(licences.NOTICES, "licence string, text string"))
    got = sorted((str(r.doc_id), r.licence, r.notice_lines, r.notices)
                 for r in licences.licence_scan(docs, known).collect())
    want = [("1", "ISC", 0, ""), ("2", "ISC", 0, ""), ("3", None, 0, ""), ("4", None, 0, ""), ("5", None, 0, ""),
            ("6", "MIT", 1, "MIT"), ("7", None, 3, "CC-BY-NC-4.0,MIT"), ("7", None, 0, ""), ("8", None, 0, ""),
            ("None", "ISC", 0, "")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licences.licence_scan(docs.where("false"), known).count() == 0
    assert licences.licence_scan(docs, known.where("false")).where("licence IS NOT NULL").count() == 0
