import re
from itertools import permutations

from codelake.llm import filter_audit

SPACE = "[^\x20\x09-\x0d]+"
DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def fails(rows, i):
    text = rows[i][1] or ""
    words = re.findall(SPACE, text)
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        out.add("C")
    if re.search("[#$%&*|]", text):
        out.add("D")
    if rows[i][0] is not None and any(d is not None and d < rows[i][0] and (t or "") == text for d, t, *_ in rows):
        out.add("E")
    return out


def brute(rows, labels):
    masks = [fails(rows, i) for i in range(len(rows))]
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], m) for r, m in zip(rows, masks, strict=True) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone, alive = [x for x in alive if f in x[1]], [x for x in alive if f not in x[1]]
                failing = sum(f in m for _, m in own)
                earlier = failing - len(gone)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(alive), len(gone), earlier, sum(m == {f} for _, m in own),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def got(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in (*filter_audit.COUNTS, "shapley")]
            for r in df.collect()}


def test_rows_of_every_kind(spark):
    long = " ".join(f"word{i}" for i in range(250))
    rows = [(1, long, "a"), (2, long, "a"), (3, long, "b"), (4, long + " #", "a"), (5, "short & Loud", "b"),
            (6, "w " * 300, None), (7, "w " * 300, ""), (8, None, "a"), (9, "", None), (9, "", None),
            (9, "", "b"), (None, "", "b"), (None, long, "a"), (10, "UPPER " * 220, "c"), (10, "UPPER " * 220, "c"),
            (11, "é一   $ " * 90, "c"), (12, "x\u000bY\u000cz " * 100, "c"),
            (13, "\x1cA " * 210, "c"), (14, "A" * 49 + "a" * 2401 + " b" * 199, "a"), (15, long.upper(), "a")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (5, 0, 1), (8, 1, 0), (9, 1, 0), (None, 1, 1),
              (10, 1, None), (77, 1, 1)]
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    out = filter_audit.interaction_audit(df, marks)
    assert out.count() == 600 * 4
    assert got(out) == brute(rows, labels)
    odd = (df.withColumnRenamed("doc_id", "digest").withColumnRenamed("text", "_words")
           .withColumnRenamed("source", "n").selectExpr("*", "1 AS id", "2 AS part", "'x' AS bits"))
    assert got(filter_audit.interaction_audit(odd, marks, "digest", "_words", "n")) == brute(rows, labels)
    assert filter_audit.interaction_audit(df.where("false"), marks).count() == 0
    assert got(filter_audit.interaction_audit(df, marks.where("false"))) == brute(rows, [])


def test_many_copies_and_documents(spark):
    rows = ([(i, "the same & text", f"s{i % 3}") for i in range(1, 400)]
            + [(1000 + i, f"text {i % 7} " * (60 + i), "s0") for i in range(40)])
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 1040, 3)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    out = got(filter_audit.interaction_audit(df, spark.createDataFrame([(a, b, int(c)) for a, b, c in labels], LABELS)))
    assert out == brute(rows, labels)
    assert all(sum(out[p, "ABCDE", s][1] for s in range(1, 6)) + out[p, "ABCDE", 5][0]
               == sum(r[2] == p for r in rows) for p in ("s0", "s1", "s2"))


def test_no_python_in_the_plan(spark):
    df = filter_audit.op13_filter_audit(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
