import numpy as np
import pytest

from codelake.llm import decontaminate as d


def edit_distance(a, b):
    """Least distance of a to any stretch of b, cell by cell."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(names, int(rng.integers(8, 40))))) for i in range(40)]
    docs = []
    for i in range(400):
        body = list(rng.choice([*names, "x", "y", "z"], int(rng.integers(0, 120))))
        if i % 2:
            item = items[int(rng.integers(len(items)))][1].split()
            for _ in range(int(rng.integers(0, d.limit(len(item)) + 2))):
                at = int(rng.integers(len(item)))
                kind = int(rng.integers(3))
                item[at:at + (kind > 0)] = [str(rng.choice(names))] if kind < 2 else []
            at = int(rng.integers(len(body) + 1))
            body[at:at] = item
        docs.append((i, " ".join(body).title() + "!"))
    return docs, items


def test_distance_is_exact(case):
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(1, 6, rng.integers(1, 12))
        b = rng.integers(0, 6, rng.integers(0, 25))
        dist, s, e = d.distance(a, b)
        assert dist == edit_distance(a.tolist(), b.tolist())
        assert 0 <= s <= e <= len(b)


def test_recall_and_precision_against_all_pairs(spark, case):
    docs, items = case
    want = set()
    for i, text in docs:
        for j, item in items:
            a = d.words_of(item)
            if edit_distance(a, d.words_of(text)) <= d.limit(len(a)):
                want.add((i, j))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.contaminated(frame, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= want
    assert len(found) >= 0.97 * len(want) > 100
    for r in got:
        assert r.edits <= d.limit(r.item_words) and r.start_word < r.end_word
    kept = {r.doc_id for r in d.drop_contaminated(frame, bench).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in found}


def test_blocks_give_the_same(spark, case, monkeypatch):
    docs, items = case
    frame = spark.createDataFrame(docs[:60], "doc_id long, text string")
    bench = spark.createDataFrame(items[:12], "item_id long, text string")
    exact = {(i, j) for i, t in docs[:60] for j, x in items[:12] if x in t.lower()}
    monkeypatch.setattr(d, "BLOCK_WORDS", 60)
    assert exact <= {(r.doc_id, r.item_id) for r in d.contaminated(frame, bench).collect()}


def test_edge_rows(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, None, "a"), (2, "", "b"), (3, f"{'word ' * 60000} {item} end", None),
            (None, item.upper(), "c"), (4, "one two three four", "d"), (4, item, "e"), (4, item, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "..."), (4, item)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.start_word, r.edits) for r in d.contaminated(frame, bench).collect())
    assert got == sorted([("3", j, 60000, 0) for j in (1, 4)] + [("None", j, 0, 0) for j in (1, 4)]
                         + [("4", j, 0, 0) for j in (1, 4)] * 2)
    kept = d.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r.item_id for r in kept.collect()) == ["a", "b", "d"]
    assert d.drop_contaminated(frame, bench.where("false")).count() == len(rows)
    assert d.contaminated(frame.where("false"), bench).count() == 0


def test_items_shortened_at_the_end_of_a_text(spark):
    """An item with deleted words as a whole document, and as the last words of one."""
    rng = np.random.default_rng(9)
    names = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(names, int(rng.integers(8, 40))))) for i in range(40)]
    docs = []
    for i, item in items:
        for k in range(1, 3):
            body = item.split()
            for _ in range(min(k, d.limit(len(body)))):
                del body[int(rng.integers(len(body)))]
            docs.append((10 * i + k, " ".join(body)))
            docs.append((10 * i + 4 + k, " ".join([*rng.choice(["x", "y", "z"], 30), *body])))
    want = {(i, j) for i, text in docs for j, item in items
            if edit_distance(d.words_of(item), d.words_of(text)) <= d.limit(len(d.words_of(item)))}
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= want and len(found) >= 0.97 * len(want) >= 0.97 * len(docs)


def test_recall_of_long_items_among_short_ones():
    """Repetitions come from each size: short items first in the file take nothing from the long ones."""
    rng = np.random.default_rng(6)
    short = [(i, [f"s{w}" for w in rng.integers(0, 300, 3)]) for i in range(64)]
    long = [(64 + i, [f"w{w}" for w in rng.integers(0, 3000, 100)]) for i in range(40)]
    search = d.Searcher(short + long)
    hit = total = 0
    for i in range(64, 104):
        for _ in range(8):
            other = d.edited(search.items[i], d.limit(100), rng, 1 << 20)
            text = np.concatenate([np.zeros(50, np.int64), other, np.zeros(150, np.int64)])
            found = search.candidates(text, np.full(len(text), 50 + len(other)))
            hit += [50, i] in found.tolist()  # the window that begins with the leaked words
            total += 1
    assert hit >= 0.96 * total
