"""Language-model scores by deleted interpolation.

The probability of a token after its predecessor mixes three estimates: the bigram's relative
frequency, the token's relative frequency and a uniform share. The mixture weights depend on how
often the predecessor was seen, in buckets by powers of two. A fold of the training documents is
deleted from the counts, and expectation-maximisation learns the weights of each bucket on it; the
scores then use the counts of all training documents with these weights.

Counting and scoring go over chunks of documents (see chunks.py): a chunk sends its distinct words
and bigrams with their counts and gets back the counts of the whole corpus. What moves grows with
the corpus; a frequent word or bigram is one key of each chunk. The statistics for the expectation step are
counts on a fixed grid of probability ratios.

Edge cases: a null text counts as empty and has the end token only. Documents that share an id are
scored, and counted, one by one; a null id counts as the empty text when documents are dealt into
folds. Without training documents every count is zero and the score is uniform; without a deleted fold the
weights are equal. An empty table gives an empty result. Keys are 64-bit hashes of words and bigrams.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.chunks import (REQUEST, answered, answers_in, bucketed, chunk_count, groups, mixed,
                                 requests_of, unplaned)
from codelake.llm.common import remainder, ship, stored, table, text_bytes

ship(__name__)

CHUNK = 10 << 20  # bytes of text
FOLDS, HELD_OUT, DELETED = 7, 2, 3
BUCKETS = 24  # of context frequency
STEP = 4  # grid cells for a factor of two
CELLS = 64 * STEP
ROUNDS = 100
WORDS, PAIRS, TOTALS = 1, 2, 3  # kinds of requests and answers
WITHOUT = 10  # added to the kind of answers that leave the deleted fold out
END = np.uint64(0x2545F4914F6CDD1D)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
RANDOM = np.random.default_rng(6).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.cumprod(np.full(1 << 16, BASE, np.uint64))


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, an end token after each text, and where each text starts."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    word = ~BLANK[data]
    edges = np.diff(np.concatenate([[False], word]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    inside = np.flatnonzero(word)
    lengths = ends - starts
    place = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = RANDOM[data[inside]] * POWERS[place % len(POWERS)]
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths) if len(starts) else np.zeros(0, np.uint64)
    hashes = mixed(sums + lengths.astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts]) - 1
    until = np.searchsorted(starts, stops)  # words before the end of each text
    tokens = np.insert(hashes, until, END)
    return tokens, np.concatenate([[0], until[:-1] + np.arange(1, len(texts))])


class Tokens:
    """The tokens of a chunk and its distinct words and bigrams."""

    def __init__(self, docs: pa.Table):
        texts = docs["text"].to_pylist()
        parts = [token_hashes(texts[s]) for s in groups([len(t) for t in texts], 1 << 20)]
        tokens = np.concatenate([p[0] for p in parts])
        sizes = np.concatenate([np.diff(np.append(p[1], len(p[0]))) for p in parts])
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes
        before = np.concatenate([[END], tokens[:-1]])
        self.words, self.word_of = np.unique(tokens, return_inverse=True)
        self.before = np.searchsorted(self.words, before)
        pairs = mixed(before * BASE + tokens)
        self.pairs, self.pair_of = np.unique(pairs, return_inverse=True)
        self.training = np.repeat(docs["role"].to_numpy() != HELD_OUT, sizes)

    def counts(self, of: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(of[self.training], minlength=n).astype(np.int64)


def _requests(ranges: int) -> Callable:
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        own, chunk = Tokens(docs), key[0].as_py()
        rows = [requests_of(chunk, WORDS, ranges, own.words, [own.counts(own.word_of, len(own.words))]),
                requests_of(chunk, PAIRS, ranges, own.pairs, [own.counts(own.pair_of, len(own.pairs))])]
        return pa.Table.from_batches(rows)
    return run


def _summed(kept: int) -> Callable:
    """Answers: the counts of all chunks. Chunks from number kept on, which hold the deleted fold, also
    get the counts without theirs. Totals: tokens and types with and without that fold."""
    def answer(kind: int, chunks: np.ndarray, keys: np.ndarray, facts: list[np.ndarray]):
        _, of = np.unique(keys, return_inverse=True)
        whole = np.bincount(of, facts[0]).astype(np.int64)
        main = np.bincount(of, facts[0] * (chunks < kept)).astype(np.int64)
        totals = np.array([whole.sum(), (whole > 0).sum(), main.sum(), (main > 0).sum()], np.int64)
        extra = [(-1, TOTALS, totals)] if kind == WORDS else []
        cuts = np.flatnonzero(np.diff(chunks)) + 1
        extra += [(int(c[0]), kind + WITHOUT, m) for c, m in
                  zip(np.split(chunks, cuts), np.split(main[of], cuts), strict=True) if c[0] >= kept]
        return whole[of], extra
    return answer


def estimates(own: Tokens, words: np.ndarray, pairs: np.ndarray, total: int) -> tuple:
    """For each token the bigram and the unigram estimate, and the bucket of its context."""
    context = words[own.before]
    high = np.divide(pairs[own.pair_of], context, out=np.zeros(len(context)), where=context > 0)
    low = words[own.word_of] / max(1, total)
    bucket = np.minimum(BUCKETS - 1, np.ceil(np.log2(context + 1.0))).astype(np.int64)
    return high, low, bucket


def _cell(ratio: np.ndarray) -> np.ndarray:
    """Grid cell of a ratio of an estimate to the uniform share; 0 stands for none."""
    with np.errstate(divide="ignore"):
        cell = np.rint(np.log2(ratio) * STEP) + CELLS // 2
    return np.where(ratio > 0, np.clip(cell, 1, CELLS - 1), 0).astype(np.int64)


def learned(grid: np.ndarray) -> np.ndarray:
    """Mixture weights (bucket, [bigram, unigram, uniform]) from rows (bucket, cell, cell, count)."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]  # no context
    if not len(grid):
        return weights
    bucket, n = grid[:, 0].astype(int), grid[:, 3]
    parts = np.ones((len(grid), 3))
    for k in (0, 1):
        parts[:, k] = np.where(grid[:, 1 + k] > 0, 2.0 ** ((grid[:, 1 + k] - CELLS // 2) / STEP), 0)
    seen = np.unique(bucket)
    for _ in range(ROUNDS):
        share = weights[bucket] * parts
        share *= (n / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], 1)
        sums[:, 2] += 1e-3 * n.sum() / BUCKETS / 1e6 + 1e-6  # the uniform share never vanishes
        weights[seen] = sums[seen] / sums[seen].sum(axis=1, keepdims=True)
    for b in range(1, BUCKETS):  # a bucket without deleted tokens takes the weights of its neighbour
        if b not in seen:
            weights[b] = weights[max((s for s in seen if s < b and s), default=min((s for s in seen if s > b), default=b))]
    return weights


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    slim = docs.select(F.col(id_column).alias("doc_id"), text_bytes(text_column).alias("text"),
                       remainder(id_column, FOLDS).cast("int").alias("role"))
    kept = chunk_count(slim, "text", chunk_bytes)
    deleted = -(-kept // (FOLDS - 1))
    spread = F.xxhash64("doc_id", "text")
    chunk = F.when(F.col("role") == DELETED, F.pmod(spread, F.lit(deleted)) + kept).otherwise(
        F.pmod(spread, F.lit(kept))).cast("int")
    chunks = bucketed(slim.withColumn("chunk", chunk), "chunk", kept + deleted, "lm_chunks")
    ranges = kept + deleted
    requests = chunks.groupBy("chunk").applyInArrow(_requests(ranges), REQUEST)
    answers = stored(answered(requests, _summed(kept), [np.int64]), "lm-answers", compression="zstd")

    totals = np.zeros(4, np.int64)
    for row in answers.where(F.col("kind") == TOTALS).collect():  # one short row for each range of keys
        totals += unplaned(row.answer, np.int64)
    total, types, main_total, main_types = (int(x) for x in totals)

    def grid(docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = Tokens(docs)
        high, low, bucket = estimates(own, answers_in(answers, WORDS + WITHOUT, np.int64),
                                      answers_in(answers, PAIRS + WITHOUT, np.int64), main_total)
        cells = np.stack([bucket, _cell(high * (main_types + 1)), _cell(low * (main_types + 1))], 1)
        code, n = np.unique(cells @ [CELLS * CELLS, CELLS, 1], return_counts=True)
        return pa.Table.from_arrays([pa.array(code), pa.array(n)], names=["cell", "n"])

    parts = (chunks.where(F.col("chunk") >= kept).groupBy("chunk")
             .cogroup(answers.where(F.col("kind").isin(WORDS + WITHOUT, PAIRS + WITHOUT)).groupBy("chunk"))
             .applyInArrow(grid, "cell long, n long"))
    rows = parts.groupBy("cell").agg(F.sum("n").alias("n")).collect()  # as many as the grid has cells
    cells = np.array([[r.cell // CELLS**2, r.cell // CELLS % CELLS, r.cell % CELLS, r.n] for r in rows])
    weights = learned(cells.reshape(-1, 4).astype(float))

    def scores(docs: pa.Table, answers: pa.Table) -> pa.Table:
        own, words = Tokens(docs), answers_in(answers, WORDS, np.int64)
        high, low, bucket = estimates(own, words, answers_in(answers, PAIRS, np.int64), total)
        mix = weights[bucket]
        p = mix[:, 0] * high + mix[:, 1] * low + mix[:, 2] / (types + 1)
        seen = words[own.word_of]
        base = np.log10((seen + 1) / (total + types + 1))
        n = docs.num_rows
        sums = [np.add.reduceat(x, own.starts) for x in ((seen > 0).astype(np.int64), base, np.log10(p))]
        return pa.Table.from_arrays([
            docs["doc_id"], pa.array(docs["role"].to_numpy() == HELD_OUT), pa.array(own.sizes.astype(np.int64)),
            pa.array(sums[0]), pa.array(np.full(n, total)), pa.array(sums[1]), pa.array(sums[2])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = chunks.select("doc_id").schema.add("held_out", "boolean")
    for name in ("n_tokens", "n_known", "train_tokens"):
        schema = schema.add(name, "long")
    schema = schema.add("base_score", "double").add("score", "double")
    return (chunks.groupBy("chunk").cogroup(answers.where(F.col("kind").isin(WORDS, PAIRS)).groupBy("chunk"))
            .applyInArrow(scores, schema))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_language_model": op6_language_model}
SQL: dict[str, str] = {}
