"""Exact dedup with a Bloom filter built in two passes.

The first pass hashes every text to a few slots of a bit map and finds the slots hit more than
once; those form the filter. The second pass looks every text up in it. A text with a slot hit
once only has no copy and passes straight through; only the others shuffle, by their SHA-256, for
the exact answer. Everything is built from DataFrame functions.

Edge cases: a null text counts as empty. A null id is smaller than any other. Rows that share text
and id are one document: the report marks all or none of them as kept, the filter keeps one.
An empty table gives an empty result. Other columns are carried along and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import fresh, stored, table

PAGE = 8 * 4096  # bits of one bitmap of Spark's bitmap functions


def slots(text: Column, bits: int, hashes: int) -> Column:
    """The slots of a text, each in 1..bits."""
    out, h = [], F.xxhash64(text)
    for _ in range(hashes):
        out.append(F.pmod(h, F.lit(bits)) + 1)
        h = F.xxhash64(h)
    return F.array(*out)


def bit_is_set(bitmap: Column, slot: Column) -> Column:
    position = F.bitmap_bit_position(slot)
    byte = F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("bigint")
    return F.coalesce(F.getbit(value, F.pmod(position, F.lit(8)).cast("int")) == 1, F.lit(False))


def flagged(docs: DataFrame, text: Column, flag: str, bits_per_row: int, hashes: int,
            max_filter_bytes: int) -> DataFrame:
    """docs with a flag that is false only for texts without a copy.

    The filter takes bits_per_row bits a row. It is broadcast while it has at most
    max_filter_bytes; beyond that every row is flagged, so that all digests are compared.
    """
    bits = PAGE
    while bits < bits_per_row * docs.count():
        bits *= 2
    if bits // 8 > max_filter_bytes:
        return docs.withColumn(flag, F.lit(True))
    again = (docs.select(F.explode(slots(text, bits, hashes)).alias("slot")).groupBy("slot")
             .agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    pages = stored(again.groupBy(F.bitmap_bucket_number("slot").alias("page"))
                   .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")),
                   "repeated-slots")
    own, page, found = fresh(docs, "_slots", "_page", "_bits")
    out = docs.withColumn(own, slots(text, bits, hashes)).withColumn(flag, F.lit(True))
    for i in range(hashes):
        side = F.broadcast(pages.select(F.col("page").alias(page), F.col("bits").alias(found)))
        slot = F.element_at(F.col(own), i + 1)
        out = (out.join(side, F.bitmap_bucket_number(slot) == F.col(page), "left")
               .withColumn(flag, F.col(flag) & bit_is_set(F.col(found), slot)).drop(page, found))
    return out.drop(own)


def duplicate_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     bits_per_row: int = 16, hashes: int = 2,
                     max_filter_bytes: int = 256 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = docs.select(F.col(id_column).alias("doc_id"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    marked = stored(
        flagged(slim, F.col("text"), "maybe", bits_per_row, hashes, max_filter_bytes)
        .select("doc_id", F.sha2("text", 256).alias("text_sha256"), "maybe"), "digests")
    candidates = marked.where("maybe").drop("maybe")
    groups = stored(candidates.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    alone = marked.where("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    rest = candidates.join(groups, "text_sha256").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return alone.select(columns).unionByName(rest.select(columns))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                bits_per_row: int = 16, hashes: int = 2,
                max_filter_bytes: int = 256 << 20) -> DataFrame:
    """docs without copies: of equal texts the row with the largest id stays."""
    digest, maybe, keep_digest, keep_id = fresh(docs, "_digest", "_maybe", "_keep_digest", "_keep_id")
    text = F.coalesce(F.col(text_column), F.lit(""))
    marked = flagged(docs, text, maybe, bits_per_row, hashes, max_filter_bytes)
    candidates = marked.where(F.col(maybe)).withColumn(digest, F.sha2(text, 256))
    best = stored(candidates.groupBy(F.col(digest).alias(keep_digest))
                  .agg(F.max(id_column).alias(keep_id)), "kept-copies")
    rest = (candidates.join(best, (F.col(digest) == F.col(keep_digest))
                            & F.col(id_column).eqNullSafe(F.col(keep_id)))
            .dropDuplicates([digest]))
    return (marked.where(~F.col(maybe)).select(docs.columns)
            .unionByName(rest.select(docs.columns)))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_report(table(spark, sf_dir, "documents"))


SQL = {"op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""}
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
