import re

import numpy as np

from codelake.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out, left = sum(sizes.values()), {}, set(names)
    while left:
        rest = total - sum(out.values())
        over = [s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 3 * sizes[s]]
        if not over:
            out.update({s: rest * weight[s] / sum(weight[x] for x in left) for s in left})
            break
        out.update({s: 3 * sizes[s] for s in over})
        left -= set(over)
    return out


def brute_rates(sizes, target):
    """The tilt by bisection."""
    x = np.array(sizes) / np.mean(sizes)
    if target >= 3 * sum(sizes) * (1 - 1e-9):
        return np.full(len(x), 3.0)
    low, high = -1e4, 1e4
    for _ in range(300):
        mid = (low + high) / 2
        words = (np.minimum(3, np.exp(np.minimum(mid * x, 2))) * sizes).sum()
        low, high = (mid, high) if words < target else (low, mid)
    return np.minimum(3, np.exp(np.minimum(low * x, 2)))


def check(df, rows):
    out = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    key = lambda r: str((r.doc_id, r.source, r.text))
    assert sorted(map(key, out)) == sorted(str((d, s, t)) for d, s, t in rows)
    assert sorted((key(r), r.mix.taken) for r in out) == sorted((key(r), r.mix.taken) for r in again)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goals = brute_targets(sizes)
    for s in sizes:
        own = [r for r in out if r.source == s]
        assert all(r.mix.size == size(r.text) and r.mix.source_size == sizes[s] for r in own)
        assert all(abs(r.mix.target - goals[s]) <= 1e-6 * max(1, goals[s]) for r in own)
        assert all(0 <= r.mix.copies <= 3 and r.mix.taken == r.mix.copies * r.mix.size for r in own)
        some = [r for r in own if r.mix.size]
        if some and goals[s]:
            want = brute_rates([r.mix.size for r in some], goals[s])
            assert np.allclose([r.mix.rate for r in some], want, rtol=1e-4, atol=1e-5)
            assert abs(sum(r.mix.taken for r in own) - goals[s]) <= max(r.mix.size for r in some)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text")
    check(df, [tuple(r) for r in df.collect()])


def test_edge_rows(spark):
    rows = ([(i, "b", "w " * (i % 7)) for i in range(40)] + [(i, None, "w x y") for i in range(9)]
            + [(None, "tiny", "one word"), (7, "tiny", None), (7, "tiny", ""), (8, "c", " "), (9, "", "a b"),
               (1, "long", "v " * 90_000), (2, "long", "v"), (2, "long", "v")])
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    check(df, rows)
    named = df.withColumnRenamed("text", "mix").withColumnRenamed("doc_id", "_size")
    out = mixing.mix(named, "_size", "source", "mix")
    assert out.columns == ["_size", "source", "mix", "mix_"]
    assert out.count() == len(rows)
    assert mixing.mix(df.where("false")).count() == 0
