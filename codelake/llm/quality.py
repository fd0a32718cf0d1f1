"""Quality scores from document statistics.

Every text becomes a short vector of statistics (lengths, shares of character kinds, word and line
repetition). Random Fourier features of the standardised vector approximate a Gaussian kernel. The
labelled training rows are summed partition by partition into normal equations, which give the
ridge weights; the raw scores of a slice of the training rows that the ridge has not seen are
counted on a fixed grid, and isotonic regression over that grid turns scores into probabilities.
The driver only ever sees matrices and grids of fixed size.

Edge cases: a null text counts as empty; empty and very long texts get a score like any other.
Labels of a null id, null labels and labels without a document are ignored; of several labels of
one document the largest counts. Without any label every score is 0.5, with one class only it is
near that class. Rows that share an id are scored one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from codelake.llm.common import fresh, remainder, rows_of, ship, sliced, stored, table, text_bytes

ship(__name__)

FEATURES = 256  # random Fourier features
RIDGE = 1e-3  # per training row
GRID = 2048  # calibration bins for raw scores in [-0.5, 1.5]
SEED = 20
#: Byte values by kind: fixed values of ASCII.
KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789", "blank": b" \t", "stop": b".,;:?'\"()-", "loud": b"!",
    "mark": b"#$%&*+/<=>@[\\]^_`{}~", "bar": b"|", "line": b"\n\r"}
DIMENSIONS = 20


def statistics_of(text: bytes) -> np.ndarray:
    """The statistics of one whole text; empty texts give zeros for every share."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    kinds = [counts[list(chars)].sum() / n for chars in KINDS.values()]
    shares = counts[counts > 0] / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    w = max(1, len(words))
    stopped = sum(map(text.count, (b". ", b".\n"))) + text.endswith(b".")
    return np.array([
        *kinds, counts[128:].sum() / n, -(shares * np.log2(shares)).sum() / 8,
        np.log1p(len(words)) / 10, np.log1p(len(text)) / 12, len(text) / w / 20,
        np.log(len(set(words)) / w) if words else 0.0, np.log1p(max(map(len, words), default=0)) / 5,
        np.log1p(len(lines)) / 8, len(set(lines)) / max(1, len(lines)),
        np.sqrt(stopped / w), len(words) > 0], float)


def features_of(docs: DataFrame, keep: list[str], text_column: str) -> DataFrame:
    """The columns of keep and the vector as array<float>."""
    text, = fresh(docs, "_text")
    slim = docs.select(*keep, text_bytes(text_column).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            stats = [statistics_of(t).astype(np.float32) for t in rows_of(batch, text)]
            vectors = pa.array(stats, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), vectors],
                                             names=[*keep, "vector"])

    return slim.mapInArrow(run, slim.drop(text).schema.add("vector", ArrayType(FloatType())))


def matrix_of(batch: pa.RecordBatch, column: str = "vector") -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(column))
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, DIMENSIONS)


def lift(mean: np.ndarray, scale: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Vectors -> a constant, the standardised vector and random Fourier features of it."""
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(DIMENSIONS, FEATURES)) / np.sqrt(DIMENSIONS)
    phases = rng.uniform(0, 2 * np.pi, FEATURES)

    def apply(x: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / scale, -8, 8)
        waves = np.sqrt(2 / FEATURES) * np.cos(z @ directions + phases)
        return np.hstack([np.ones((len(x), 1)), z / 10, waves])

    return apply


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each statistic over the rows."""
    each = [F.element_at("vector", i + 1).cast("double") for i in range(DIMENSIONS)]
    row = rows.agg(*(F.avg(c) for c in each), *(F.stddev_pop(c) for c in each)).first()
    values = np.array([0.0 if v is None else v for v in row])
    scale = values[DIMENSIONS:]
    return values[:DIMENSIONS], np.where(scale > 1e-6, scale, 1.0)


def _ridge(rows: DataFrame, apply: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """Ridge weights for label from the normal equations summed over the partitions of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = apply(matrix_of(batch))
                y = batch.column(batch.schema.get_field_index("label")).to_numpy().astype(float)
                part = np.hstack([x.T @ x, (x.T @ y)[:, None]])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))],
                names=["i", "sums"])

    parts = rows.select("vector", "label").mapInArrow(run, "i long, sums array<double>")
    added = (parts.select("i", F.posexplode("sums").alias("j", "value")).groupBy("i", "j")
             .agg(F.sum("value").alias("value")).collect())  # of fixed size
    if not added:
        return None
    size = 1 + max(r.i for r in added)
    sums = np.zeros((size, size + 1))
    for r in added:
        sums[r.i, r.j] = r.value
    gram = sums[:, :size] + RIDGE * sums[0, 0] * np.eye(size)
    return np.linalg.solve(gram, sums[:, size])


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((raw + 0.5) / 2 * GRID), 0, GRID - 1).astype(int)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in the order of x; centres and levels of the blocks."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n, strict=True):
        blocks.append([xi * ni, yi * ni, ni])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    array = np.array(blocks)
    return array[:, 0] / array[:, 2], array[:, 1] / array[:, 2]


def _calibration(rows: DataFrame, apply: Callable, weights: np.ndarray) -> tuple[np.ndarray, ...] | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((GRID, 2))
        for batch in batches:
            if batch.num_rows:
                at = _bin(apply(matrix_of(batch)) @ weights)
                y = batch.column(batch.schema.get_field_index("label")).to_numpy().astype(float)
                np.add.at(total, at, np.stack([np.ones(len(y)), y], 1))
        some = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in (0, 1))],
                                         names=["bin", "n", "good"])

    grid = (rows.select("vector", "label").mapInArrow(run, "bin long, n double, good double")
            .groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
            .orderBy("bin").collect())  # GRID rows at most
    if not grid:
        return None
    at, n, good = (np.array([r[k] for r in grid], float) for k in range(3))
    return isotonic((at + 0.5) / GRID * 2 - 0.5, (good + 0.5 * good.sum() / n.sum()) / (n + 0.5), n)


def fit(labelled: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A function from vectors to scores, from rows (vector, label, slice); slice 0 calibrates."""
    mean, scale = _moments(labelled)
    apply = lift(mean, scale)
    weights = _ridge(labelled.where("slice <> 0"), apply)
    if weights is None:  # too few rows for a slice of their own
        weights = _ridge(labelled, apply)
    if weights is None:
        return lambda x: np.full(len(x), 0.5)
    levels = _calibration(labelled.where("slice = 0"), apply, weights) or \
        _calibration(labelled, apply, weights)

    def score(x: np.ndarray) -> np.ndarray:
        raw = apply(x) @ weights
        # The last hundredth keeps the order of documents on one level.
        return np.clip(0.99 * np.interp(raw, *levels) + 0.01 * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)

    return score


def model(vectors: DataFrame, labels: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Fit on the labelled rows of vectors (doc_id, vector) that are not held out."""
    known = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
             .agg(F.max("quality").cast("double").alias("label")))
    rows = (vectors.where(remainder("doc_id", 3) != 1).join(known, "doc_id")
            .select("vector", "label", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("slice")))
    return fit(stored(rows, "labelled"))


def quality_scores(docs: DataFrame, labels: DataFrame, text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    vectors = stored(features_of(docs, ["doc_id"], text_column), "statistics")
    score = model(vectors, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score(matrix_of(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)],
                                             names=["doc_id", "held_out", "score"])

    slim = vectors.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "vector")
    schema = slim.drop("vector").schema.add("score", "double")
    return slim.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of docs whose score is 0.5 or more. The texts are read twice, to fit and to filter,
    and never shuffled."""
    score = model(features_of(docs, ["doc_id"], text_column), labels)
    text, good = fresh(docs, "_text", "_good")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if batch.num_rows:
                stats = np.stack([statistics_of(t) for t in rows_of(batch, text)])
                stats = stats.astype(np.float32).astype(float)
                rows = batch.select(range(batch.num_columns - 1))
                yield rows.filter(pa.array(score(stats) >= 0.5))

    return docs.withColumn(text, text_bytes(text_column)).mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_quality": op3_quality}
SQL: dict[str, str] = {}
