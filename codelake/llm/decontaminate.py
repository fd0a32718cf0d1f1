"""Benchmark decontamination by edit distance.

Texts and items are sequences of words (lower case, letters and digits). A window of a document
contaminates it when its edit distance to an item of n words is at most n / 5. The CGK random walk
turns such a sequence into three times as many symbols so that edit distance becomes Hamming
distance; one walk and a few sampled positions of it make a key, and windows of an item's length
that share a key with the item in one of several repetitions are candidates. The number of
repetitions follows from the wanted recall, for each item size: on items of the size edited up to the
limit, the driver measures how often one repetition keeps a key. Candidates are then compared exactly with the text around
the window. A window may reach past the end of its text by the limit of edits; what is missing counts
as an empty word, as in an item whose words were deleted.

One edit breaks q runs of q words at most, so a window with too few pairs or triples of words that
occur in any item cannot match and gets no key; that loses nothing. Items are handled in blocks of bounded size, one pass over the
documents for each block; texts never shuffle.

Edge cases: a null text counts as empty and matches nothing; items without words or with a null
text match nothing; equal items are all reported. Rows that share an id are documents of their own.
Empty tables give an empty result (no documents) or leave every document alone (no items).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import fresh, rows_of, ship, sliced, table

ship(__name__)

WORD = re.compile(r"[^\W_]+")
SAMPLED = 3  # positions of a walk in a key
RECALL = 0.98  # per matching window at the limit of edits
BLOCK_WORDS = 500_000  # words of the items that one pass holds
TRIALS = 32  # edited items of each size, at least, on which the collision rate is measured
TRIAL_CELLS = 1 << 21  # words times walks of a trial that are in memory at once
PROBES = 1 << 18  # windows times walks, or words, that are compared at once
CHUNK = 1 << 19  # words of documents that are searched at once
SEED = 4


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def limit(n: int) -> int:
    return n // 5


def shared(n: int, q: int) -> int:
    """Runs of q words that n words keep at least at the limit of edits: one edit breaks q runs."""
    return n - q + 1 - q * limit(n)


def runs(ids: np.ndarray, q: int) -> np.ndarray:
    """A number for each run of q words, zero with a foreign word."""
    out, native = np.zeros(max(0, len(ids) - q + 1), np.uint64), np.ones(max(0, len(ids) - q + 1), bool)
    for i in range(q):
        own = ids[i:len(out) + i]
        out = (out + own.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        native &= own > 0
    return np.where(native, (out ^ (out >> np.uint64(31))) | np.uint64(1), np.uint64(0))


class Walks:
    """CGK walks over words given as small numbers, with the sampled positions that make the keys."""

    def __init__(self, repetitions: int):
        rng = np.random.default_rng(SEED)
        self.salts = rng.integers(0, 2**63, (4096, repetitions), dtype=np.uint64)
        self.sampled = np.sort(rng.random((SAMPLED, repetitions)), axis=0)  # as shares of the walk

    def first(self, repetitions: int) -> Walks:
        out = Walks.__new__(Walks)
        out.salts, out.sampled = self.salts[:, :repetitions], self.sampled[:, :repetitions]
        return out

    def keys(self, ids: np.ndarray, starts: np.ndarray, n: int, ends: np.ndarray | None = None) -> np.ndarray:
        """The keys (walk, window) of the windows of n words that begin at starts in ids; words from ends on
        (one for each window) are empty."""
        words = np.vstack([ids[np.minimum(starts + i, len(ids) - 1)] for i in range(n)]
                          + [np.zeros(len(starts), np.int64)])
        for i in range(n) if ends is not None and (ends - starts < n).any() else ():
            words[i, starts + i >= ends] = 0
        words = words.astype(np.uint64).ravel()  # the symbols of all windows, place by place
        wanted = (self.sampled * 3 * n).astype(int)
        at = np.tile(np.arange(len(starts)), (self.salts.shape[1], 1))  # into words
        end = n * len(starts)
        key = np.full(at.shape, n, np.uint64)
        for step in range(int(wanted.max()) + 1):
            symbol = words[at]
            for walk in np.nonzero(wanted == step)[1]:
                new = (key[walk] ^ symbol[walk]) * np.uint64(0x9E3779B97F4A7C15)
                key[walk] = new ^ (new >> np.uint64(29))
            symbol += self.salts[step % len(self.salts)][:, None]
            symbol *= np.uint64(0xBF58476D1CE4E5B9)
            symbol >>= np.uint64(63)  # the coin
            at += symbol.astype(np.int64) * len(starts) * (at < end)
        return key


def edited(ids: np.ndarray, edits: int, rng: np.random.Generator, alphabet: int) -> np.ndarray:
    out = ids.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        if kind == 0 or len(out) < 2:
            out.insert(at, int(rng.integers(1, alphabet)))
        elif kind == 1:
            del out[at]
        else:
            out[at] = int(rng.integers(1, alphabet))
    return np.array(out, np.int64)


def repetitions_for(items: list[np.ndarray], recall: float) -> int:
    """Repetitions after which a window at the limit of edits shares a key with its item; the items have one size.

    Edits differ in how often they keep a key, so it is the mean over the trials that must reach the recall."""
    n, rng = len(items[0]), np.random.default_rng(SEED)
    some = items * -(-TRIALS // len(items))
    other = [np.concatenate([edited(x, limit(n), rng, 1 << 20), np.zeros(n, np.int64)])[:n] for x in some]
    walks = 64
    while True:
        trial, hits, step = Walks(walks), [], max(1, TRIAL_CELLS // (n * walks))
        for low in range(0, len(some), step):
            ids, others = (np.concatenate(x[low:low + step]) for x in (some, other))
            starts = np.arange(0, len(ids), n)
            hits.append((trial.keys(ids, starts, n) == trial.keys(others, starts, n)).sum(axis=0))
        kept = np.concatenate(hits)
        if kept.mean() >= 4 or walks >= 1 << 12:
            break
        walks *= 4  # too few for a rate
    missed = 1 - (kept + 1) / (walks + 2)  # a trial without a hit has a rate above zero, too
    low, high = 4, 8
    while (missed ** high).mean() > 1 - recall:
        low, high = high, 2 * high
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if (missed ** middle).mean() <= 1 - recall else (middle + 1, high)
    return low


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of item to a stretch of text: (distance, start, end)."""
    m = len(text)
    row, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i, word in enumerate(item, 1):
        swap = row[:-1] + (text != word)
        best = np.concatenate([[i], np.minimum(swap, row[1:] + 1)])
        frm = np.concatenate([[0], np.where(swap <= row[1:] + 1, begin[:-1], begin[1:])])
        along = best - np.arange(m + 1)
        low = np.minimum.accumulate(along)
        origin = np.maximum.accumulate(np.where(along == low, np.arange(m + 1), 0))
        row, begin = low + np.arange(m + 1), frm[origin]
    end = int(row.argmin())
    return int(row[end]), int(begin[end]), end


class Runs:
    """The runs of q words of all items, each with the sizes of the items that have it."""

    def __init__(self, own: list[np.ndarray], sizes: np.ndarray):
        pairs = np.unique(np.stack([np.concatenate(own), np.repeat(sizes, [len(x) for x in own]).astype(np.uint64)], 1),
                          axis=0)
        self.codes, first = np.unique(pairs[:, 0], return_index=True)
        self.sizes = np.split(pairs[:, 1].astype(np.int64), first[1:])
        bits = 1 << 16
        while bits < 32 * len(self.codes):
            bits *= 2
        self.bloom = np.zeros(bits, bool)
        self.bloom[self.codes % np.uint64(bits)] = True
        self.with_size = {int(n): np.array([n in own for own in self.sizes]) for n in np.unique(sizes)}

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of codes that are runs of items, and which ones."""
        at = np.flatnonzero((codes > 0) & self.bloom[codes % np.uint64(len(self.bloom))])
        run = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        true = self.codes[run] == codes[at]
        return at[true], run[true]

    def enough(self, at: np.ndarray, run: np.ndarray, n: int, q: int, last: int) -> np.ndarray:
        """For every window of n words (`last` of them) whether it has enough runs of items of that size."""
        before = np.zeros(last + n - q + 1, np.int32)
        before[at[self.with_size[n][run]] + 1] = 1
        np.cumsum(before, out=before)
        return before[n - q + 1:] - before[:last] >= shared(n, q)


class Searcher:
    """Finds the items of one block in documents."""

    def __init__(self, items: list[tuple[object, list[str]]], recall: float = RECALL):
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws), 1)}
        self.names = [name for name, _ in items]
        self.items = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in items]
        sizes = np.array([len(x) for x in self.items])
        self.sizes = np.unique(sizes)
        groups = {n: np.flatnonzero(sizes == n) for n in self.sizes.tolist()}
        self.repetitions = {n: repetitions_for([self.items[i] for i in own], recall) for n, own in groups.items()}
        self.walks = Walks(max(self.repetitions.values()))  # each size takes the first ones
        self.keys: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}  # for each size and walk keys in order, items
        for n, own in groups.items():
            same = np.concatenate([self.items[i] for i in own])
            keys = self.walks.first(self.repetitions[n]).keys(same, np.arange(len(own)) * n, n)
            order = np.argsort(keys, axis=1, kind="stable")
            self.keys[n] = [(k[o], own[o]) for k, o in zip(keys, order, strict=True)]
        self.runs = {q: [np.unique(runs(x, q)) for x in self.items] for q in (2, 3)}
        self.known = {q: Runs(own, sizes) for q, own in self.runs.items()}

    def candidates(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(start, item) pairs whose window shares a key; ends: for each word, where its text ends."""
        places, found_in = {}, {}
        for q, known in self.known.items():
            codes = runs(ids, q)
            at, run = known.look_up(codes)
            order = np.argsort(codes[at], kind="stable")
            places[q], found_in[q] = (codes[at][order], at[order]), (at, run)
        found = [np.zeros(0, np.int64)]
        for n in self.sizes.tolist():
            last = len(ids) - n + limit(n) + 1
            if last <= 0:
                continue
            ok = ends[:last] - np.arange(last) >= n - limit(n)
            for q, (at, run) in found_in.items():
                if n >= q and shared(n, q) > 0:
                    ok &= self.known[q].enough(at, run, n, q, last)
            starts, walks = np.flatnonzero(ok), self.walks.first(self.repetitions[n])
            step = max(1, PROBES // max(n, self.repetitions[n]))
            for low in range(0, len(starts), step):
                own = starts[low:low + step]
                probes = walks.keys(ids, own, n, ends[own])
                for probe, (keys, items) in zip(probes, self.keys[n], strict=True):
                    left, right = (np.searchsorted(keys, probe, side) for side in ("left", "right"))
                    many = right - left
                    at = np.repeat(np.arange(len(own)), many)
                    if len(at):
                        offset = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                        found.append(own[at] * len(self.items) + items[left[at] + offset])
        pairs = np.stack(np.divmod(np.unique(np.concatenate(found)), len(self.items)), 1)
        return self._alike(places, pairs)

    def _alike(self, places: dict[int, tuple[np.ndarray, np.ndarray]], pairs: np.ndarray) -> np.ndarray:
        """Drop windows with too few runs of the item for the limit; places: runs in order, and where
        each is."""
        keep = np.ones(len(pairs), bool)
        by_item = np.argsort(pairs[:, 1], kind="stable")
        cuts = np.flatnonzero(np.diff(pairs[by_item, 1])) + 1
        for rows in np.split(by_item, cuts) if len(pairs) else []:
            item, starts = pairs[rows[0], 1], pairs[rows, 0]
            n = len(self.items[item])
            for q, (codes, where) in places.items():
                left, right = (np.searchsorted(codes, self.runs[q][item], side) for side in ("left", "right"))
                own = np.sort(np.concatenate([where[a:b] for a, b in zip(left, right, strict=True)] or [[]]))
                inside = np.searchsorted(own, starts + n - q + 1) - np.searchsorted(own, starts)
                keep[rows] &= inside >= shared(n, q)
        return pairs[keep]

    def matches(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item, start, end, distance) of every item in it, its best place."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        get = self.vocabulary.get
        for row, text in enumerate(texts):
            ids = np.array(list(map(get, words_of(text), repeat(0))), np.int64)
            if len(ids):
                held.append((row, ids))
                size += len(ids)
            if size >= CHUNK:
                self._search(held, out)
                held, size = [], 0
        if held:
            self._search(held, out)
        return out

    def _search(self, held: list[tuple[int, np.ndarray]], out: list) -> None:
        lengths = np.array([len(ids) for _, ids in held])
        stops = np.cumsum(lengths)
        ids = np.concatenate([x for _, x in held])
        pairs = self.candidates(ids, np.repeat(stops, lengths))
        places: dict[tuple[int, int], list[int]] = {}
        for start, item in pairs.tolist():
            text = int(np.searchsorted(stops, start, side="right"))
            places.setdefault((text, item), []).append(start)
        for (text, item), starts in sorted(places.items()):
            own, first, stop = self.items[item], int(stops[text] - lengths[text]), int(stops[text])
            slack, best, reached = 2 * limit(len(own)), None, -1
            for start in starts:  # sorted; one comparison covers the starts near each other
                if start <= reached:
                    continue
                low, high = max(first, start - slack), min(stop, start + 2 * len(own) + slack)
                reached = high - len(own) - slack if high < stop else stop  # later ones see no more of the text
                d, s, e = distance(own, ids[low:high])
                if d <= limit(len(own)) and (best is None or d < best[3]):
                    best = (item, low + s - first, low + e - first, d)
            if best:
                out[held[text][0]].append(best)


def blocks_of(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[object, list[str]]]]:
    """The items in blocks that are bounded in words; they come to the driver one at a time."""
    block: list[tuple[object, list[str]]] = []
    size = 0
    for row in items.select(F.col(id_column).cast("long"), text_column).toLocalIterator():
        words = words_of(row[1] or "")
        if words:
            if block and size + len(words) > BLOCK_WORDS:
                yield block
                block, size = [], 0
            block.append((row[0], words))
            size += len(words)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, recall: float = RECALL, item_id: str = "item_id",
                 item_text: str = "text", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start_word, end_word, edits,
    item_words. The place is the closest one, of equal ones the first."""
    slim = docs.select(F.col(id_column).alias("doc_id"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    schema = slim.select("doc_id").schema
    for name in ("item_id", "start_word", "end_word", "edits", "item_words"):
        schema = schema.add(name, "long")

    def finder(search: Searcher) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                found = search.matches(rows_of(batch, "text"))
                rows = [i for i, x in enumerate(found) for _ in x]
                flat = [m for x in found for m in x]
                columns = [pa.array([search.names[m[0]] for m in flat], pa.int64())]
                columns += [pa.array([m[k] for m in flat], pa.int64()) for k in (1, 2, 3)]
                columns.append(pa.array([len(search.items[m[0]]) for m in flat], pa.int64()))
                if flat:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=schema.names)
        return run

    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks_of(items, item_id, item_text):
        out = out.unionByName(slim.mapInArrow(finder(Searcher(block, recall)), schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, recall: float = RECALL, item_id: str = "item_id",
                      item_text: str = "text", text_column: str = "text") -> DataFrame:
    """The rows of docs in which no item is found."""
    text, = fresh(docs, "_text")

    def keeper(search: Searcher) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                clean = pa.array([not m for m in search.matches(rows_of(batch, text))], pa.bool_())
                yield batch.select(range(batch.num_columns - 1)).filter(clean)
        return run

    for block in blocks_of(items, item_id, item_text):
        docs = (docs.withColumn(text, F.coalesce(F.col(text_column), F.lit("")))
                .mapInArrow(keeper(Searcher(block, recall)), docs.schema))
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}
SQL: dict[str, str] = {}
