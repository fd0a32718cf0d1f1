import numpy as np

from codelake.llm import language


def pages(spark):
    docs = spark.createDataFrame(
        [(i, t, lang) for i, (t, lang) in enumerate(
            [("the cat and the dog with the thing that was there", "en"), ("der hund und die katze sind nicht hier", "de"),
             ("le chat et la souris dans les champs sont loin", "fr"), (None, "en"), ("no label", None)] * 5)],
        "doc_id long, text string, lang string")
    rows = [(1, "http://www.a.de/x", "<html lang='de'><p>der hund und die katze</p>"),
            (2, "http://www.a.de/y", "<html lang=de><script>the the the</script>"),
            (3, "http://b.com", "<html lang='de-DE'>the cat and the dog"), (4, None, None), (5, "odd", ""),
            (5, "http://[::1]/", "la souris dans les champs"), (None, "http://c.fr", "x" * 200_000)]
    rows += [(100 + i, "http://www.a.de/z", "<html lang=de>die katze und der hund sind nicht") for i in range(30)]
    rows += [(200 + i, "http://b.com", "<html lang=en>the thing that was there with the cat") for i in range(30)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, likely string"), docs


def test_evidence_is_weighed(spark):
    frame, docs = pages(spark)
    out = language.identify(frame, docs).collect()
    assert len(out) == frame.count()
    lang = {r.page_id: r.lang for r in out if r.page_id not in (5, None)}
    assert lang[1] == "de" and lang[2] == "de" and lang[3] == "en"
    assert {r.text_lang for r in out if r.page_id == 2} == {None}
    assert {r.lang for r in out if r.page_id == 5} >= {"fr"}
    assert all(0 < r.confidence <= 1 for r in out)
    assert language.identify(frame.where("false"), docs).count() == 0
    none = language.identify(frame, docs.where("false"))
    assert none.count() == frame.count() and none.where("lang IS NOT NULL").count() == 0


def test_priors_lean_on_the_level_above():
    own = np.array([[0.5, 0.5]])
    zero = np.zeros((1, 2))
    said = np.array([False])
    base = np.array([50.5, 50.5])

    def post(**sums):
        return language.fused(own, base, {**dict.fromkeys((*language.LEVELS, "declared"), zero), **sums}, said)[0, 0]
    assert abs(post() - 0.5) < 1e-9
    suffix = post(suffix=np.array([[90.5, 10.5]]))
    assert 0.8 < suffix < 0.95
    assert post(suffix=np.array([[90.5, 10.5]]), host=np.array([[0.5, 2.5]])) < suffix
    assert post(suffix=np.array([[90.5, 10.5]]), host=np.array([[0.5, 200.5]])) < 0.1


def test_pages_of_the_tables(spark):
    out = language.op1_language(spark, "/root/testdata/sf0.01").collect()
    agree = [r.lang == r.declared for r in out if r.declared]
    assert len(out) == 250 and sum(agree) / len(agree) > 0.95
    assert sum(r.text_lang == r.declared for r in out) / len(out) > 0.95
