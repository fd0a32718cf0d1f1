"""How filters interact: for every order of the filters, what each step removes, part by part.

Each document gets a mask with one bit for every filter that it fails. Documents are counted by part
and mask, so that a part has at most 2 ** filters cells however many documents it holds; from there on
everything is a fold inside one row per part. For each cell `transform` runs along the constant array
of all orders and `aggregate` walks the steps of an order, which gives one struct of weighted counts
per order and step; the cells of a part are merged by elementwise sums (`zip_with` in an `aggregate`).
The documents themselves are read once; what shuffles is one slim row for each distinct document.

The filter for copies needs the whole table: of rows with the same text, those whose id is larger than
the smallest id fail it. Both sides are counted instead of joined back to the documents: `firsts` are
the rows at the smallest id of their text, all other rows with an id fail. No key of a join is shared
by the copies of a text, so a text that a third of all rows hold needs no special care.

Edge cases: a null or empty text has no words and fails A only (and E as a copy). A null part is the
empty string and joins the part of that name. A row with a null id is neither a copy nor has copies.
Rows that repeat an id count as often as they occur, and none of them is a copy of the other. Labels
that repeat an id count as one that has quality or toxic 1 in any of them; documents without a label
are neither good nor toxic. An empty table gives no parts and no rows. Other columns may have any name.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import fresh, stored, table

SPACE = "[\\x20\\x09-\\x0D]+"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
#: Under 200 words; few different words; many capitals; a special character; a copy of a smaller id.
LETTERS = "ABCDE"


def failures(texts: DataFrame, text: str, bits: str) -> DataFrame:
    """texts with bits, the filters that look at one text alone, in place of the text (not null)."""
    words, many, unlike = fresh(texts, "_words", "_many", "_unlike")
    # one select after another, so that the words of a text are cut out once
    cut = texts.withColumn(words, F.array_remove(F.split(text, SPACE), ""))
    sized = cut.withColumn(many, F.size(words)).withColumn(unlike, F.size(F.array_distinct(words)))
    fails = [F.col(many) < 200, F.col(unlike).cast("long") * 100 < F.col(many).cast("long") * 50,
             F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 2,
             F.col(text).rlike("[#$%&*|]")]
    marks = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
    return sized.withColumn(bits, sum(marks[1:], marks[0]).cast("int")).drop(text, words, many, unlike)


def cells(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          part_column: str = "source") -> DataFrame:
    """part, mask (bit i: fails filter i), n, n_good, n_toxic."""
    slim = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(part_column), F.lit("")).alias("part"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    rows = failures(slim, "text", "bits").groupBy("id", "part", "digest", "bits").agg(F.count(F.lit(1)).alias("n"))
    known = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").groupBy("id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    no = F.lit(False)
    marked = stored(rows.join(known, "id", "left").select(
        "id", "part", "digest", "bits", "n", F.coalesce("good", no).alias("good"),
        F.coalesce("bad", no).alias("bad")), "marked-documents")
    kind = ["part", "bits", "good", "bad"]
    # of each text and kind of row: all rows, and those at the smallest id
    held = stored(marked.where("id IS NOT NULL").groupBy("digest", *kind).agg(
        F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least")), "texts-by-kind")
    first = held.groupBy("digest").agg(F.min("least.id").alias("id"))
    firsts = held.select("digest", *kind, F.col("least.id").alias("id"), F.col("least.n").alias("n")).join(
        first, ["digest", "id"]).select(*kind, "n")
    copy = F.lit(1 << LETTERS.index("E"))
    signed = (firsts.unionByName(marked.where("id IS NULL").select(*kind, "n"))
              .select("part", F.col("bits").alias("mask"), "good", "bad", "n")
              .unionByName(firsts.select("part", F.col("bits").bitwiseOR(copy).alias("mask"), "good", "bad",
                                         (-F.col("n")).alias("n")))
              .unionByName(held.select("part", F.col("bits").bitwiseOR(copy).alias("mask"), "good", "bad",
                                       "n")))
    weight = F.sum("n")
    return signed.groupBy("part", "mask").agg(
        weight.alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("n_toxic")).where("n > 0")


def _numbers(orders: list[tuple[int, ...]]) -> Column:
    """The array of orders, a constant of the plan."""
    return F.expr("array(" + ", ".join(f"array({', '.join(map(str, o))})" for o in orders) + ")")


def _counts(alive: Column, bit: Column, cell: Column) -> Column:
    """What one step adds up for the documents of a cell."""
    mask = cell["mask"]
    fails = mask.bitwiseAND(bit) != 0
    out = alive & fails

    def of(when: Column, n: str = "n") -> Column:
        return F.when(when, cell[n]).otherwise(F.lit(0).cast("long"))

    return F.struct(of(alive & ~fails).alias("kept"), of(out).alias("removed"),
                    of(fails & ~alive).alias("redundant"), of(mask == bit).alias("unique_fails"),
                    of(out, "n_good").alias("good_lost"), of(out, "n_toxic").alias("toxic_lost"))


def _walk(order: Column, cell: Column) -> Column:
    """The steps of one order for one cell."""
    step = "struct<kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,good_lost:bigint,toxic_lost:bigint>"
    start = F.struct(F.lit(True).alias("alive"), F.array().cast(f"array<{step}>").alias("steps"))

    def take(state: Column, filter_no: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), filter_no)
        alive = state["alive"]
        return F.struct((alive & (cell["mask"].bitwiseAND(bit) == 0)).alias("alive"),
                        F.concat(state["steps"], F.array(_counts(alive, bit, cell))).alias("steps"))

    return F.aggregate(order, start, take, lambda state: state["steps"])


def audit(cell_rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, the counts, and shapley, for cells as `cells` gives them."""
    orders = list(permutations(range(len(letters))))
    every = _numbers(orders)
    size = len(orders) * len(letters)
    zero = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), size)
    parts = cell_rows.groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))  # 2 ** filters at most

    def add(a: Column, b: Column) -> Column:
        return F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])

    merged = parts.select("part", F.aggregate(
        "cells", zero, lambda so_far, cell: F.zip_with(
            so_far, F.flatten(F.transform(every, lambda order: _walk(order, cell))), add)).alias("steps"))
    filters = F.flatten(every)
    names = F.array(*[F.lit("".join(letters[i] for i in o)) for o in orders])

    def removed_by(i: int) -> Column:
        own = F.zip_with("steps", filters, lambda s, f: F.when(f == i, s["removed"]).otherwise(0))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b)

    shares = merged.withColumn("shares", F.array(*[removed_by(i) for i in range(len(letters))]))
    rows = shares.select("part", "shares", F.posexplode("steps").alias("at", "counts"))
    order_no, step = F.floor(F.col("at") / len(letters)).cast("int"), F.col("at") % len(letters)
    return rows.select(
        "part", F.get(names, order_no).alias("filter_order"), (step + 1).cast("int").alias("step"),
        *[f"counts.{c}" for c in COUNTS], F.get("shares", F.get(filters, F.col("at"))).alias("shapley"))


def interaction_audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id",
                      text_column: str = "text", part_column: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step."""
    return audit(cells(docs, labels, id_column, text_column, part_column))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = {"op13_filter_audit": """
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM texts t LEFT JOIN known k ON t.doc_id = k.doc_id
), cell AS (
  SELECT part, fails, count(*) AS n, sum(good) AS n_good, sum(bad) AS n_toxic FROM masks GROUP BY part, fails
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND hit THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, contains(fails, x) AS hit,
               before <> '' AND regexp_matches(fails, '[' || before || '_]') AS gone FROM cell, steps)
  GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted"""}
QUERIES = {"op13_filter_audit": op13_filter_audit}
