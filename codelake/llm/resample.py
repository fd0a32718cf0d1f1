"""Importance resampling of documents towards a target distribution over hashed word runs.

Every run of one to three words is a feature; its bucket is the CRC-32 of its bytes modulo a fixed
number of buckets. Buckets are counted over all documents and all target texts, a bucket's gain is
the scaled logarithm of the ratio of its smoothed shares, and a document weighs the sum of the gains of
its features. The documents to draw are those with the highest weight plus Gumbel noise, which samples
without replacement in proportion to the exponential of the weight.

CRC-32 is linear over XOR: the CRC of a span is the XOR of what each byte adds at its distance from the
end of the span, and of a constant of the length. A table holds these contributions for every byte at
distances up to BLOCK; spans of a text that lie side by side (every n-th run of n words) are looked up
in one go and joined by `bitwise_xor.reduceat`. Longer spans are cut into blocks of BLOCK bytes from their
end and folded pairwise, a left block moved on by the length of what follows it.

Counts leave a task as one row per bucket, so the driver only ever sees one number per bucket. Ranks come
from a range sort of slim rows that is numbered part by part.

Edge cases: a null or empty text, or one without words, has no features, weight zero and its noise as
score; only documents with enough words are drawn. A null id hashes like the empty text and loses ties
against others. Rows that repeat an id have the same noise and are ranked one by one; which of equal
rows gets which rank makes no difference to the result. Empty documents give an empty result; without
target texts all gains follow from smoothing. Other columns of docs are ignored and may have any name.
A text is cut into pieces of bounded size between words, so only a single word of that size needs more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import rows_of, ship, stored, table, text_bytes
from codelake.operators.skew import numbered

ship(__name__)

BUCKETS = 10_000
LONGEST = 3  # words of a feature
BLOCK = 64  # bytes whose distances from the end are in the table; a power of two
POLYNOMIAL = 0xEDB88320  # of CRC-32, bits reversed
PIECE = 1 << 18  # bytes of words hashed at once
HELD = 1 << 22  # bytes of texts held at once


# CRC-32 as a linear map


@cache
def _bytes_at() -> np.ndarray:
    """Flat table: entry (d + 1) * 256 + b is what byte b adds at distance d from the end; row 0 is zero."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & np.uint32(1), (one >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), one >> np.uint32(1))
    rows = [np.zeros(256, np.uint32), one]
    while len(rows) <= BLOCK:
        rows.append(one[rows[-1] & np.uint32(255)] ^ (rows[-1] >> np.uint32(8)))
    return np.concatenate(rows)


@cache
def _moves(power: int) -> np.ndarray:
    """Four tables, one for each byte of a remainder, that move it on by 2 ** power bytes."""
    if power == 0:
        one, b = _bytes_at()[256:512], np.arange(256, dtype=np.uint32)
        return np.stack([one, b, b << np.uint32(8), b << np.uint32(16)])
    half = _moves(power - 1)
    return np.stack([_moved(half[i], power - 1) for i in range(4)])


def _moved(values: np.ndarray, power: int) -> np.ndarray:
    """Remainders after 2 ** power more zero bytes."""
    t = _moves(power)
    low = np.uint32(255)
    return (t[0][values & low] ^ t[1][values >> np.uint32(8) & low] ^ t[2][values >> np.uint32(16) & low]
            ^ t[3][values >> np.uint32(24)])


@cache
def _short_constants() -> np.ndarray:
    return _constants_of(np.arange(1 << 12))


def _constants_of(lengths: np.ndarray) -> np.ndarray:
    out = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    for power in range(int(lengths.max(initial=0)).bit_length()):
        out = np.where(lengths >> power & 1, _moved(out, power), out)
    return ~out


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of so many zero bytes each."""
    short = _short_constants()
    if lengths.max(initial=0) < len(short):
        return short[lengths]
    return _constants_of(lengths)


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[starts[i]:ends[i]] for spans in order, each not empty, one byte between neighbours."""
    lengths = ends - starts
    blocks = (lengths + BLOCK - 1) // BLOCK
    most = int(blocks.max())
    if most == 1:
        begin, stop, after = starts, ends, None
    else:
        after = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(int(blocks.sum()))  # blocks behind
        stop = np.repeat(ends, blocks) - after * BLOCK
        begin = np.maximum(np.repeat(starts, blocks), stop - BLOCK)
    first, last = int(begin[0]), int(ends[-1])
    width = np.diff(begin, append=last)
    place = np.repeat(stop, width) - np.arange(first, last)  # zero for the byte between two spans
    values = _bytes_at()[(place << 8) + data[first:last]]
    found = np.bitwise_xor.reduceat(values, begin - first)
    power = BLOCK.bit_length() - 1
    while after is not None and most > 1:  # neighbours join from the end; an odd first block waits
        whole = np.flatnonzero(after % 2 == 0)
        has_left = (whole > 0) & (np.roll(after, 1)[whole] == after[whole] + 1)
        left = np.where(has_left, _moved(found[whole - 1], power), np.uint32(0))
        found, after = found[whole] ^ left, after[whole] // 2
        most, power = (most + 1) // 2, power + 1
    return found ^ length_constants(lengths)


# Words and features of texts

_WORD = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _WORD[_low:_high + 1] = False


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words with one space after each, starts, ends, number of words of each text)."""
    data = np.frombuffer(b"".join(t.lower() + b"\n" for t in texts), np.uint8)
    word = _WORD[data]
    before = np.concatenate([[False], word[:-1]])
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    counts = np.add.reduceat((word & ~before).astype(np.int64), firsts)
    kept = np.where(word, data, np.uint8(0x20))[word | before]
    ends = np.flatnonzero(kept == 0x20)
    return kept, np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends, ends, counts


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, CRC-32) of all features, in arrays of bounded size."""
    data, starts, ends, counts = words_of(texts)
    upto, total, at = np.cumsum(counts), len(ends), 0
    while at < total:
        # words whose features start in this piece, and the text of each
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE)))
        own = np.searchsorted(upto, np.arange(at, min(total, stop + LONGEST)), side="right")
        for n in range(1, LONGEST + 1):
            for phase in range(n):  # every n-th run lies beside the next one
                first = np.arange(at + phase, min(stop, total - n + 1), n)
                if not len(first):
                    continue
                text = own[first - at]
                same = text == own[first - at + n - 1]
                if same.any():
                    yield text[same], span_crcs(data, starts[first], ends[first + n - 1])[same]
        at = stop


def batches_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) for neighbours of bounded size."""
    size, start = 0, 0
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    for i, length in enumerate(lengths):
        if i > start and size + length > HELD:
            yield start, rows_of(batch.slice(start, i - start), column)
            start, size = i, 0
        size += length
    if start < batch.num_rows:
        yield start, rows_of(batch.slice(start), column)


def bucket_counts(texts: DataFrame, text_column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n over all features of all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in batches_of(batch, "text"):
                for _, crcs in features(some):
                    counts += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])],
                                         names=["bucket", "n"])

    parts = texts.select(text_bytes(text_column).alias("text")).mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs_counts: DataFrame, target_counts: DataFrame, buckets: int = BUCKETS,
          scale: int = 1000) -> list[int]:
    """The gain of every bucket; the counts have one row for each bucket at most, so this is bounded."""
    spark = docs_counts.sparkSession
    both = (docs_counts.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t"))
            .unionByName(target_counts.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
            .unionByName(spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("s"),
                                                     F.lit(0).alias("t"))))
    sums = stored(both.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"),
                                             F.sum("t").cast("double").alias("t")), "bucket-counts")
    totals = sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    all_s, all_t = totals.first()
    ratio = ((F.col("t") + 1) * F.lit(all_s + buckets)) / ((F.col("s") + 1) * F.lit(all_t + buckets))
    rows = sums.select("bucket", F.floor(scale * F.log(ratio)).cast("long").alias("gain")).collect()
    out = [0] * buckets
    for bucket, gain in rows:
        out[bucket] = gain
    return out


def weights(docs: DataFrame, gain: list[int], id_column: str, text_column: str) -> DataFrame:
    """doc_id, n_words, n_features, weight for each row of docs."""
    slim = docs.select(F.col(id_column).alias("doc_id"), text_bytes(text_column).alias("text"))
    schema = slim.select("doc_id").schema
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, "long")
    own = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in batches_of(batch, "text"):
                n, weight = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
                words = words_of(some)[3]
                for text, crcs in features(some):
                    n += np.bincount(text, minlength=len(some))
                    cuts = np.flatnonzero(np.diff(text, prepend=-1))
                    weight[text[cuts]] += np.add.reduceat(own[crcs % np.uint32(len(own))], cuts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(some)), *(pa.array(x) for x in (words, n, weight))],
                    names=["doc_id", "n_words", "n_features", "weight"])

    return slim.mapInArrow(run, schema)


def noise(id_column: str, seed: int = 42, scale: int = 1000) -> Column:
    """Gumbel noise in whole numbers, the same for an id at every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
             buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text",
             target_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null: not drawn), n_words.

    Of the documents with least_words or more, percent of them (rounded down) with the highest scores are
    drawn; ties go to the smaller id."""
    gain = gains(bucket_counts(docs, text_column, buckets), bucket_counts(target, target_column, buckets), buckets)
    scored = stored(weights(docs, gain, id_column, text_column)
                    .withColumn("score", F.col("weight") + noise("doc_id", seed))
                    .withColumn("_at", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    slim = scored.where(fit).select(
        (-F.col("score")).alias("_down"), F.col("doc_id").isNull().alias("_none"), "doc_id", "n_features",
        "weight", "score", "n_words", "_at")
    # the whole table is one key, whose parts are numbered one by one
    ranked = numbered(slim.withColumn("_all", F.lit(0)), ["_all"], "_down",
                      ["_none", "doc_id", "n_features", "n_words", "_at"], "rank")
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).select(columns).unionByName(rest.select(columns))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The ids drawn, in ranks: doc_id, rank."""
    return resample(docs, target, **options).where("rank IS NOT NULL").select("doc_id", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_resampling": op11_resampling}
SQL: dict[str, str] = {}
