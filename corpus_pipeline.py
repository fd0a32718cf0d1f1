"""Documents to training mix: quality, exact copies, near copies, benchmark passages, source weights.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of docs;
the last one adds a struct column mix (size, source_size, target, rate, copies, taken) and keeps the
documents taken at least once. Between stages the documents are written and read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codelake.llm import decontaminate, exact, mixing, quality, simhash
from codelake.llm.common import stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: score 0.5 or more. A null or empty text is scored like
    any other; without labels all scores are 0.5 and all documents stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; null and empty texts are equal, and a null id is the
    smallest. Of rows that repeat id and text one stays."""
    return exact.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of three-word shingles at three bits or fewer: the
    one with the smallest id. Texts without words have one fingerprint and so are one group; rows that repeat
    id and text stay or go together."""
    return simhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, in any part of the text. Null and empty texts hold none;
    with an empty benchmark all documents stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the copies taken of each. Texts without words have rate one and stay; a null
    source is a source of its own."""
    out = mixing.mix(docs)
    return out.where(out[out.columns[-1]]["copies"] > 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
]

#: The classifier, fingerprints and edit distances can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
