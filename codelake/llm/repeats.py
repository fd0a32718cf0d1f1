"""Repeated passages by a depth-limited radix sort of suffixes.

Two places hold the same 100 bytes when their suffixes agree that far. Suffixes are sorted most
significant digit first and never further than those 100 bytes, and a suffix leaves as soon as it
is alone in its group, so that hardly any reaches the last digit. Neighbouring suffixes are sorted
together (a sparse suffix array): every window of 100 bytes is represented by its anchor, the place
in it whose next 32 bytes have the least hash, so equal windows have equal anchors at equal offsets.

Digit 1 is the 32 bytes at the anchor. Digit 2 is the whole stretch that the anchor's windows cover:
where it is the same, all its windows are. For those few anchors whose first digit is shared by
different stretches, digit 3 is what eight neighbouring windows have in common, and digit 4 the
single window. A window is removed when its group has an
earlier member. Each digit is one round of requests and answers over chunks of documents (see
chunks.py): a chunk sends each distinct digit once with its earliest place, so a passage that most
documents hold is one key of each chunk.

Earlier means a smaller id (null is smallest), then, in one document, an earlier start. Rows that share
id and text are one document and get the same answer; rows that share the id only are told apart by
the hashes of their texts. A null text counts as empty; texts under 100 bytes lose nothing. An
empty table gives an empty result. Digits are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.chunks import (REQUEST, answered, answers_in, bucketed, chunk_count, mixed, requests_of)
from codelake.llm.common import ship, stored, table, text_bytes

ship(__name__)

LENGTH = 100  # bytes of a window
DIGIT = 32  # bytes of the first digit
CHUNK = 6 << 20  # bytes of text
BLOCK = 1 << 20  # bytes that are hashed at once
RUN = 8  # neighbouring windows of one anchor that digit 3 takes together
FIRST, STRETCH, CORE, WINDOW = 1, 2, 3, 4  # kinds of requests: the digits
ALONE, LATER, SPLIT = 0, 1, 2  # answers about a stretch
NONE = np.iinfo(np.int64).min  # a null id

RANDOM = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15


class Hasher:
    """Hashes of stretches of a block by prefix sums of a polynomial modulo 2 ** 64."""
    _power: np.ndarray | None = None
    _back: np.ndarray | None = None

    @classmethod
    def tables(cls) -> None:
        if cls._power is None:
            for name, base in (("_power", BASE), ("_back", pow(BASE, -1, 1 << 64))):
                values = np.full(BLOCK + 1, base, np.uint64)
                values[0] = 1
                setattr(cls, name, np.cumprod(values))

    def __init__(self, data: np.ndarray):
        self.tables()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(RANDOM[data] * self._power[:len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self._back[starts] + (ends - starts).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self._back[:n] + np.uint64(size))


def anchors_of(data: np.ndarray, hasher: Hasher, limits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Digit, place, and the first and last window start of every anchor of a block; limits: for each
    byte, where its document (or its part in the block) ends."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    grams = hasher.grams(DIGIT)
    low = np.uint64(BLOCK - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, have = LENGTH - DIGIT + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:n], least[width - have:width - have + n])
    starts = np.flatnonzero(limits[:n] - np.arange(n) >= LENGTH)
    place = (least[starts] & low).astype(np.int64)
    if not len(starts):
        return grams[:0], place, starts, starts
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(starts[new[1:] - 1], starts[-1])
    return grams[place[new]], place[new], starts[new], last


class Passages:
    """The anchors of a chunk. Places count the bytes of all its texts, one after the other."""

    def __init__(self, docs: pa.Table):
        rows = list(zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True))
        keyed = sorted({(NONE if d is None else d, hashlib.sha256(t).digest(), t) for d, t in rows})
        self.index = {(d, h): i for i, (d, h, _) in enumerate(keyed)}
        self.rows = [(d, self.index[NONE if d is None else d, hashlib.sha256(t).digest()]) for d, t in rows]
        self.ids = np.array([d for d, _, _ in keyed], np.int64)
        self.texts = [t for _, _, t in keyed]
        self.stops = np.cumsum([len(t) for t in self.texts])
        self.starts = self.stops - [len(t) for t in self.texts]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        parts = []
        self.hashers = []
        for at in range(0, max(1, len(self.data) - LENGTH + 1), BLOCK - LENGTH - 1):
            end = min(len(self.data), at + BLOCK - 2)
            data = self.data[at:end]
            hasher = Hasher(data)
            low, high = np.searchsorted(self.stops, [at, end - 1], side="right") if end > at else (0, 0)
            stops = np.minimum(self.stops[low:high + 1], end) - at
            limits = np.repeat(stops, np.diff(np.concatenate([[0], stops])))[:len(data)]
            digit, place, first, last = anchors_of(data, hasher, limits)
            stretch = hasher(first, last + LENGTH)
            stretch = mixed(stretch + ((place - first) * 256 + (place - last)).astype(np.uint64))
            parts.append((digit, place + at, first + at, last + at, stretch))
            self.hashers.append((at, hasher))
        self.digit, self.place, self.first, self.last, self.stretch = (
            np.concatenate([p[k] for p in parts]) for k in range(5))
        self.firsts, self.first_of, self.first_count = np.unique(
            self.digit, return_inverse=True, return_counts=True)

    def positions(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document and the place in it."""
        doc = np.searchsorted(self.stops, places, side="right")
        return doc, places - self.starts[doc]

    def narrow(self, repeated: np.ndarray) -> None:
        """Keep the anchors whose first digit occurs elsewhere; repeated: the answers to it."""
        self.kept = np.flatnonzero(repeated[self.first_of] > 0)
        pairs = np.stack([self.digit[self.kept], self.stretch[self.kept]], 1)
        order = np.lexsort((self.kept, pairs[:, 1], pairs[:, 0]))  # anchors are in order of their places
        sorted_pairs = pairs[order]
        new = np.concatenate([[True], (sorted_pairs[1:] != sorted_pairs[:-1]).any(axis=1)]) if len(order) else \
            np.zeros(0, bool)
        self.stretch_of = np.zeros(len(order), np.int64)
        self.stretch_of[order] = np.cumsum(new) - 1
        self.stretches = sorted_pairs[new]
        self.earliest = self.kept[order[new]]  # anchor of each stretch

    def split(self, answers: np.ndarray) -> None:
        """Mark removed windows; windows of stretches that share their digit with others stay open."""
        first_here = np.zeros(len(self.kept), bool)
        first_here[np.searchsorted(self.kept, self.earliest)] = True
        gone = (answers[self.stretch_of] == LATER) | ~first_here
        self.marks = np.zeros(len(self.data) + 1, np.int64)
        self._mark(self.first[self.kept[gone]], self.last[self.kept[gone]])
        own = self.kept[first_here & (answers[self.stretch_of] == SPLIT)]
        near, far = (self.place[own] - self.last[own]) // RUN, (self.place[own] - self.first[own]) // RUN
        row, run = spread(near, far)
        self.runs = own[row], run
        starts = self.place[own[row]] - RUN * run
        self.cores, self.core_of, self.core_count = np.unique(
            mixed(self._hashes(starts, LENGTH - RUN + 1) + run.astype(np.uint64)),
            return_inverse=True, return_counts=True)

    def separate(self, repeated: np.ndarray) -> None:
        """The windows of runs whose common bytes occur elsewhere; repeated: the answers to these."""
        some = repeated[self.core_of] > 0
        own, run = self.runs[0][some], self.runs[1][some]
        first = np.maximum(self.first[own], self.place[own] - RUN * run - RUN + 1)
        _, places = spread(first, np.minimum(self.last[own], self.place[own] - RUN * run))
        self.open = np.sort(places)
        self.windows, at, self.window_of = np.unique(self._hashes(self.open, LENGTH), return_index=True,
                                                     return_inverse=True)
        self.open_first = self.open[at]

    def _hashes(self, places: np.ndarray, size: int) -> np.ndarray:
        block = np.searchsorted([at for at, _ in self.hashers], places, side="right") - 1
        out = np.zeros(len(places), np.uint64)
        for i, (at, hasher) in enumerate(self.hashers):
            rows = np.flatnonzero(block == i)
            ends = places[rows] - at + size
            inside = ends < len(hasher.sums)
            out[rows[inside]] = hasher(places[rows[inside]] - at, ends[inside])
            for row in rows[~inside].tolist():  # across the border of two blocks
                piece = Hasher(self.data[places[row]:places[row] + size])
                out[row] = piece(np.array([0]), np.array([size]))[0]
        return out

    def close(self, later: np.ndarray) -> None:
        gone = (later[self.window_of] > 0) | (self.open != self.open_first[self.window_of])
        self._mark(self.open[gone], self.open[gone])

    def _mark(self, first: np.ndarray, last: np.ndarray) -> None:
        np.add.at(self.marks, first, 1)
        np.add.at(self.marks, last + LENGTH, -1)

    def result(self) -> pa.Table:
        removed = np.cumsum(self.marks[:-1]) > 0
        out = []
        for start, stop in zip(self.starts, self.stops, strict=True):
            own = removed[start:stop]
            edges = np.count_nonzero(own[1:] & ~own[:-1]) + int(len(own) > 0 and own[0])
            kept = self.data[start:stop][~own].tobytes()
            out.append((len(own), int(own.sum()), edges, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*(out[i] for _, i in self.rows), strict=True))
        return pa.Table.from_arrays(
            [pa.array([d for d, _ in self.rows], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]),
             pa.array(columns[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair its row and every number from first to last."""
    sizes = last - first + 1
    row = np.repeat(np.arange(len(first)), sizes)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _ask_first(ranges: int) -> Callable:
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        own = Passages(docs)
        facts = [np.minimum(own.first_count, 2).astype(np.uint8)]
        return pa.Table.from_batches([requests_of(key[0].as_py(), FIRST, ranges, own.firsts, facts)])
    return run


def _ask_stretch(ranges: int) -> Callable:
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = Passages(docs)
        own.narrow(answers_in(answers, FIRST, np.uint8))
        doc, place = own.positions(own.first[own.earliest])
        facts = [own.stretches[:, 1].copy(), own.ids[doc], place]
        return pa.Table.from_batches([requests_of(key[0].as_py(), STRETCH, ranges, own.stretches[:, 0].copy(), facts)])
    return run


def _ask_core(ranges: int) -> Callable:
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = Passages(docs)
        own.narrow(answers_in(answers, FIRST, np.uint8))
        own.split(answers_in(answers, STRETCH, np.uint8))
        facts = [np.minimum(own.core_count, 2).astype(np.uint8)]
        return pa.Table.from_batches([requests_of(key[0].as_py(), CORE, ranges, own.cores, facts)])
    return run


def _ask_window(ranges: int) -> Callable:
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = _opened(docs, answers)
        doc, place = own.positions(own.open_first)
        return pa.Table.from_batches([requests_of(key[0].as_py(), WINDOW, ranges, own.windows, [own.ids[doc], place])])
    return run


def _opened(docs: pa.Table, answers: pa.Table) -> Passages:
    own = Passages(docs)
    own.narrow(answers_in(answers, FIRST, np.uint8))
    own.split(answers_in(answers, STRETCH, np.uint8))
    own.separate(answers_in(answers, CORE, np.uint8))
    return own


def _remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
    own = _opened(docs, answers)
    own.close(answers_in(answers, WINDOW, np.uint8))
    return own.result()


def _repeated(kind: int, chunks: np.ndarray, keys: np.ndarray, facts: list[np.ndarray]) -> tuple:
    _, of = np.unique(keys, return_inverse=True)
    return (np.bincount(of, facts[0])[of] > 1).astype(np.uint8), []


def _later(of: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether an earlier row of order has the same group."""
    out = np.ones(len(of), bool)
    _, first = np.unique(of[order], return_index=True)
    out[order[first]] = False
    return out


def _stretches(kind: int, chunks: np.ndarray, keys: np.ndarray, facts: list[np.ndarray]) -> tuple:
    stretch, ids, places = facts
    order = np.lexsort((places, chunks, ids))
    digits, digit_of = np.unique(keys, return_inverse=True)
    codes = np.lexsort((stretch, digit_of))
    new = np.concatenate([[True], (np.diff(digit_of[codes]) != 0) | (np.diff(stretch[codes].view(np.int64)) != 0)])
    group = np.zeros(len(keys), np.int64)
    group[codes] = np.cumsum(new) - 1
    kinds = np.bincount(digit_of[codes[new]], minlength=len(digits))
    out = np.where(kinds[digit_of] > 1, SPLIT, ALONE)
    out[_later(group, order)] = LATER
    return out.astype(np.uint8), []


def _windows(kind: int, chunks: np.ndarray, keys: np.ndarray, facts: list[np.ndarray]) -> tuple:
    _, of = np.unique(keys, return_inverse=True)
    return _later(of, np.lexsort((facts[1], chunks, facts[0]))).astype(np.uint8), []


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text"))
    n = chunk_count(slim, "text", chunk_bytes)
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    chunks = bucketed(slim.withColumn("chunk", chunk), "chunk", n, "passages")
    answers = None
    for ask, answer, types in ((_ask_first, _repeated, [np.uint8]),
                               (_ask_stretch, _stretches, [np.uint64, np.int64, np.int64]),
                               (_ask_core, _repeated, [np.uint8]),
                               (_ask_window, _windows, [np.int64, np.int64])):
        grouped = chunks.groupBy("chunk")
        asked = (grouped.applyInArrow(ask(n), REQUEST) if answers is None
                 else grouped.cogroup(answers.groupBy("chunk")).applyInArrow(ask(n), REQUEST))
        new = stored(answered(asked, answer, types), "passage-answers", compression="zstd")
        answers = new if answers is None else answers.unionByName(new)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op7_repeats": op7_repeats}
SQL: dict[str, str] = {}
