"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the number of times the mix takes it, at most three. Among all rates
whose taken words meet the target of every source, those that stay closest to one in relative
entropy are exponentially tilted in the size of the document: rate = min(3, exp(t * size / mean)),
with one t for each source. The t solve the convex dual, which falls apart by source. A first solution comes
from a histogram of sizes, whose bins grow with the size and so are bounded for any source: its Newton steps
run inside the tasks, source by source. Newton steps over all sizes as they are, as grouped sums for all
sources at once, then remove what the bins left open. These sums are taken over whole numbers, so that reruns
agree to the last bit.

Rates are rounded to copies with one threshold a source: a document is rounded up when its hashed
number less the fraction of its rate lies below it. The threshold is found digit by digit from grouped
counts, as far as the target allows, and what is then missing is filled by the one more document that fits
best.

Edge cases: a null or empty text has size zero, rate one and takes no words. A null source is a
source of its own, ordered last. Rows that share an id are documents of their own but are rounded
alike if their text has the same size. Sources without words have target zero. An empty table gives
an empty result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.llm.common import fresh, ship, stored, table
from codelake.operators.skew import numbered

ship(__name__)

MOST = 3  # copies of a document
FINE = 64  # bins of sizes between a size and its double
EXACT = 1  # Newton steps over all sizes; the bins leave an error of about 1e-5, a step squares it
UNIT = 1 << 20  # words are summed in units of about a millionth
BITS = 18  # of the threshold found in one round
ROUNDS = 2


def size_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")),
                          F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with the target of each: weights 1, 2, 3, repeating in the order
    of the names, share all words; what exceeds three times a source is shared again by weight."""
    names = sources.select("source", F.col("source").isNull().alias("_last"), F.lit(0).alias("_all"))
    ranks = numbered(names, ["_all"], "_last", ["source"], "rank")
    own = ranks.select(F.col("source").alias("of"), ((F.col("rank") - 1) % 3 + 1).cast("double").alias("weight"))
    ranked = stored(sources.join(own, F.col("source").eqNullSafe(F.col("of"))).drop("of")
                    .withColumn("most", F.col("source_size").cast("double") * MOST), "ranked-sources")
    total, level, full = None, 0.0, -1
    while True:  # each round adds sources to the full ones or ends
        capped = F.col("most") <= F.lit(level) * F.col("weight")
        n, taken, weight, words = ranked.agg(
            F.count_if(capped), F.sum(F.when(capped, F.col("most"))),
            F.sum(F.when(~capped, F.col("weight"))), F.sum("source_size")).first()
        total = words or 0 if total is None else total
        if n == full or not weight:
            break
        full, level = n, (total - (taken or 0.0)) / weight
    return ranked.withColumn("target", F.least("most", F.lit(level) * F.col("weight"))).drop("weight", "most")


def rate(tilt: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(tilt * size / mean, F.lit(2.0))))


def _whole(value: Column) -> Column:
    return F.round(value * UNIT).cast("decimal(38,0)")


def _root(sizes: np.ndarray, counts: np.ndarray, mean: float, target: float) -> float:
    """The tilt at which documents of these sizes take so many words: Newton steps, and halving where one
    leaves the bracket of the root."""
    x, words = sizes / mean, sizes * counts
    low, high, tilt = -60 * mean, 2 * mean, 0.0
    for _ in range(200):
        rates = np.exp(np.minimum(tilt * x, 2.0))
        gap = target - float((np.minimum(rates, MOST) * words).sum())
        if abs(gap) <= target * 1e-9:
            break
        low, high = (tilt, high) if gap > 0 else (low, tilt)
        slope = float((x * rates * words)[rates < MOST].sum())
        new = tilt + min(1.0, max(-1.0, gap / max(slope, 1e-9)))
        tilt = new if low < new < high else (low + high) / 2
    return tilt


def _first_tilts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("open", "mean", "target", "bins")), strict=True)
        out = []
        for is_open, mean, target, bins in rows:
            if is_open:
                counts = np.array([b["n"] for b in bins], float)
                words = np.array([b["words"] for b in bins], float)
                out.append(_root(words / counts, counts, mean, target))
            else:
                out.append(0.0 if target <= 0 else 2 * mean)
        yield batch.drop_columns(["bins"]).append_column("tilt", pa.array(out, pa.float64()))


def tilts(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """goals (source, source_size, n_sized, bins, target) with mean and tilt of each source; sizes (source,
    size, n) counts its documents with words."""
    full = F.col("target") >= F.col("source_size") * MOST * (1 - 1e-9)
    begun = goals.select(
        "source", "source_size", "target",
        (F.col("source_size") / F.greatest(F.col("n_sized"), F.lit(1))).alias("mean"),
        ((F.col("target") > 0) & ~full).alias("open"), "bins")
    schema = begun.drop("bins").schema.add("tilt", "double")
    state = stored(begun.mapInArrow(_first_tilts, schema), "tilts")
    for _ in range(EXACT):
        own = state.where("open").select(F.col("source").alias("of"), "mean", "tilt")
        w, size = rate(F.col("tilt"), F.col("size"), F.col("mean")), F.col("size")
        bend = F.when(w < MOST, _whole(w * size * size / F.col("mean"))).otherwise(F.lit(0))
        sums = (sizes.join(own, F.col("source").eqNullSafe(F.col("of"))).groupBy("of")
                .agg(F.sum(_whole(w * size) * F.col("n")).alias("words"),
                     F.sum(bend * F.col("n")).alias("slope")))
        gap = F.col("target") - F.col("words").cast("double") / UNIT
        step = gap / F.greatest(F.col("slope").cast("double") / UNIT, F.lit(1e-9))
        step = F.when(F.abs(gap) <= F.col("target") * 1e-12, 0.0).otherwise(
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step)))
        state = stored(state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "source_size", "target", "mean", "open",
            (F.col("tilt") + F.when(F.col("slope") > 0, step).otherwise(0.0)).alias("tilt")), "tilts")
    return state.drop("open")


def _rated(sized: DataFrame, state: DataFrame, id_column: str) -> DataFrame:
    """sized with rate, whole copies and the number that decides on one more (null: never)."""
    w = F.when(F.col("_size") > 0, rate(F.col("tilt"), F.col("_size"), F.col("mean"))).otherwise(1.0)
    unit = F.pmod(F.xxhash64(id_column, "_size"), F.lit(1 << 48)) / float(1 << 48)
    part = F.col("_rate") - F.col("_whole")
    place = F.floor((unit - part + 1) / 2 * float(1 << BITS * ROUNDS)).cast("long")
    return (sized.join(state, F.col("_source").eqNullSafe(F.col("source")), "left")
            .withColumn("_rate", w).withColumn("_whole", F.floor("_rate").cast("long"))
            .withColumn("_place", F.when((part > 0) & (F.col("_size") > 0), place)))


def _up() -> Column:
    """Whether a document is rounded up."""
    one_more = (F.col("_size") == F.col("more_size")) & (F.col("_place") == F.col("more_place"))
    return F.coalesce((F.col("_place") < F.col("limit")) | one_more, F.lit(False))


def thresholds(slim: DataFrame, state: DataFrame) -> DataFrame:
    """state with limit, the place below which documents are rounded up, and the size and place of one
    more."""
    rated = _rated(slim, state, "_id").select(
        F.col("_source").alias("of"), "_size", "_place", (F.col("_whole") * F.col("_size")).alias("_base"), "target")
    # the first digit, and what whole copies take, in one pass; rows without a place go to no bin
    bins = rated.groupBy("of", F.coalesce(F.shiftright("_place", BITS), F.lit(-1)).alias("bin")).agg(
        F.sum(F.when(F.col("_place").isNotNull(), F.col("_size"))).alias("words"), F.sum("_base").alias("base"),
        F.max("target").alias("target"))
    every = Window.partitionBy("of")  # 2 ** BITS short rows for a source
    found = _cut(bins.withColumn("need", F.col("target") - F.sum("base").over(every)), F.lit(0))
    for _ in range(ROUNDS - 1):
        own = stored(found, "thresholds").select(F.col("of").alias("_of"), "need", "prefix")
        inside = rated.join(own, F.col("of").eqNullSafe(F.col("_of"))).where(
            F.shiftright("_place", BITS) == F.col("prefix"))
        bins = inside.groupBy("of", F.col("_place").bitwiseAND((1 << BITS) - 1).alias("bin")).agg(
            F.sum("_size").alias("words"), F.max("need").alias("need"), F.max("prefix").alias("prefix"))
        closer = _cut(bins, F.col("prefix"))
        # a source without documents at the prefix ends there
        found = own.join(closer.select(F.col("of"), F.col("need").alias("_need"), F.col("prefix").alias("_prefix")),
                         F.col("_of").eqNullSafe(F.col("of")), "left").select(
            F.col("_of").alias("of"), F.coalesce("_need", "need").alias("need"),
            F.coalesce("_prefix", F.shiftleft("prefix", BITS)).alias("prefix"))
    limits = stored(found.select(F.col("of").alias("_of"), "need", F.col("prefix").alias("limit")), "limits")
    more = rated.join(limits, F.col("of").eqNullSafe(F.col("_of"))).where(
        (F.col("_place") >= F.col("limit")) & (F.col("_size") <= F.col("need"))).groupBy("_of").agg(
        F.max(F.struct("_size", (-F.col("_place")).alias("up"))).alias("more"))
    ends = limits.select("_of", "limit").join(
        more.select(F.col("_of").alias("_o"), F.col("more._size").alias("more_size"),
                    (-F.col("more.up")).alias("more_place")), F.col("_of").eqNullSafe(F.col("_o")), "left").drop("_o")
    return stored(state.join(ends, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of"), "thresholds")


def _cut(bins: DataFrame, prefix: Column) -> DataFrame:
    """of, need, prefix: the bins (of, bin, words, need) of a source are taken in order as long as they fit in need; what is left
    of it, and prefix with the number of the first bin not taken as next digit."""
    upto = Window.partitionBy("of").orderBy("bin")
    fits = F.coalesce("upto", F.lit(0)) <= F.col("need")
    rows = bins.withColumn("upto", F.sum("words").over(upto)).withColumn("shifted", F.shiftleft(prefix.cast("long"), BITS))
    return rows.groupBy("of").agg(
        (F.max("need") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0))).alias("need"),
        (F.max("shifted") + F.coalesce(F.max(F.when(fits, F.col("bin"))) + 1, F.lit(0))).alias("prefix"))


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source",
        text_column: str = "text") -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken in a struct column mix."""
    mixed, = fresh(docs, "mix")
    sized = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_column).alias("_id"),
                        F.col(source_column).alias("_source"), size_of(F.col(text_column)).alias("_size"))
    slim = stored(sized.select("_id", "_source", "_size"), "sizes")
    counted = stored(slim.groupBy(F.col("_source").alias("source"), F.col("_size").alias("size"))
                     .agg(F.count(F.lit(1)).alias("n")), "size-counts")
    binned = counted.groupBy("source", F.floor(F.log2(F.greatest("size", F.lit(1))) * FINE).alias("bin")).agg(
        F.sum(F.col("size") * F.col("n")).alias("words"),
        F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n"))
    sources = stored(binned.groupBy("source").agg(
        F.sum("words").alias("source_size"), F.sum("n").alias("n_sized"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.struct("bin", "n", "words")))).alias("bins")), "sources")
    state = tilts(counted.where("size > 0"), targets(sources))
    out = _rated(sized, thresholds(slim, state), "_id")
    copies = F.col("_whole") + _up().cast("long")
    return out.select("_row.*", F.struct(
        F.col("_size").alias("size"), "source_size", "target", F.col("_rate").alias("rate"),
        copies.alias("copies"), (copies * F.col("_size")).alias("taken")).alias(mixed))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken",
                            "mix.rate", "mix.copies")


QUERIES = {"op5_mixing": op5_mixing}
SQL: dict[str, str] = {}
