"""Language of web pages from several kinds of evidence.

The text likelihood comes from byte trigrams, counted for each language over a table of labelled
documents. The declared language of the markup is weighed by how often pages of each language
declare it, the address suffix and the host by hierarchically smoothed priors: a host leans on its
registered domain, that on its suffix, that on all pages. All these tables are sums of the pages'
text posteriors grouped by declaration, suffix, domain and host; a page's own share is taken out
before it is judged by them.

Edge cases: null or empty markup gives no text and no declaration, a null or odd address no host;
what is missing adds no evidence, and a page without any gets the prior of all pages. Very long pages are
read whole. Documents without language or text teach nothing. Rows that share an id are judged one
by one. Without labelled documents the language is null. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from codelake.llm.common import rows_of, ship, sliced, stored, table, text_bytes

ship(__name__)

BUCKETS = 1 << 14  # of hashed trigrams
LANGUAGES = 500  # most languages that may be told apart; more end the job
TRUST = 60.0  # trigrams whose evidence counts in full; more are weighed down to as many
STRENGTH = 8.0  # pages that the next level of the hierarchy counts for
UNKNOWN = 1e-3

TAGS = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]{1,32};")
DECLARED = re.compile(rb"(?is)<html\b[^>]{0,1000}?\blang\s*=\s*[\"']?([A-Za-z]{2,8})"
                      rb"|<meta\b[^>]{0,1000}?content-language[^>]{0,1000}?content\s*=\s*[\"']?([A-Za-z]{2,8})")


def trigrams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of the letters of a text; anything else in ASCII is a blank."""
    codes = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    letter = (codes >= 128) | ((codes >= 97) & (codes <= 122))
    codes = np.where(letter, codes, 32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    mixed = (codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(18)).astype(np.int64)


def trigram_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """(lang, bucket, n) over labelled documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in sliced(batches, 500):
            for lang, text in zip(rows_of(batch, "lang"), rows_of(batch, "text"), strict=True):
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some),
                                              pa.array(counts[some])], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(lang_column).isNotNull()).select(
        F.col(lang_column).alias("lang"), text_bytes(text_column).alias("text"))
    return (rows.mapInArrow(run, "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def log_likelihoods(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and log P(trigram | language), one row each: a table of bounded size."""
    counts = stored(counts, "trigrams")
    names = [r.lang for r in counts.select("lang").distinct().orderBy("lang").limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    sums = np.full((len(names), BUCKETS), 0.5)
    place = {name: i for i, name in enumerate(names)}
    for r in counts.collect():
        sums[place[r.lang], r.bucket] += r.n
    return names, np.log(sums / sums.sum(axis=1, keepdims=True)).astype(np.float32)


def page_texts(pages: DataFrame, logs: np.ndarray, markup_column: str, keep: list[str]) -> DataFrame:
    """The columns of keep, declared, trigrams, and the text posterior as array<double>."""
    slim = pages.select(*keep, text_bytes(markup_column).alias("_markup"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            declared, sizes, posts = [], [], []
            for markup in rows_of(batch, "_markup"):
                said = DECLARED.search(markup)
                declared.append((said[1] or said[2]).decode().lower()[:8] if said else None)
                grams = trigrams(TAGS.sub(b" ", markup))
                sums = logs[:, grams].sum(axis=1, dtype=np.float64) * min(1.0, TRUST / max(1, len(grams)))
                odds = np.exp(sums - sums.max())
                sizes.append(len(grams))
                posts.append(odds / odds.sum())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(declared, pa.string()),
                 pa.array(sizes, pa.int64()), pa.array(posts, pa.list_(pa.float64()))],
                names=[*keep, "declared", "trigrams", "likely"])

    schema = slim.drop("_markup").schema.add("declared", "string").add("trigrams", "long")
    return slim.mapInArrow(run, schema.add("likely", ArrayType(DoubleType())))


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, registered domain (its last two names) and suffix of an address; null without a host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)", 2))
    host = F.when(host != "", host)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    suffix = F.regexp_extract(host, r"\.([^.0-9]+)$", 1)
    return host, F.when(domain != "", domain), F.when(suffix != "", suffix)


def _sums(rows: DataFrame, keys: list[str], of: str, k: int, name: str) -> DataFrame:
    """An array of k numbers summed for each value of the keys."""
    each = [F.sum(F.element_at(of, i + 1)) for i in range(k)]
    return rows.groupBy(*keys).agg(F.array(*each).alias(name))


def host_sums(rows: DataFrame, k: int) -> DataFrame:
    """Text posteriors summed for each host, with the sums of its domain and its suffix. Those are sums
    over hosts, so the pages are grouped once."""
    hosts = stored(_sums(rows.where("host IS NOT NULL"), ["host", "domain", "suffix"], "likely", k, "host_sums"),
                   "host-sums")
    out = hosts
    for level in ("domain", "suffix"):
        sums = _sums(hosts.where(F.col(level).isNotNull()), [level], "host_sums", k, f"{level}_sums")
        out = out.join(sums.withColumnRenamed(level, f"_{level}"), F.col(level) == F.col(f"_{level}"), "left")
    return stored(out.select(F.col("host").alias("_host"), "host_sums", "domain_sums", "suffix_sums"), "host-priors")


LEVELS = ("suffix", "domain", "host")  # each leans on the one before


def fused(own: np.ndarray, base: np.ndarray, sums: dict[str, np.ndarray], said: np.ndarray) -> np.ndarray:
    """Posterior of each page (row) from its text posterior, the grouped sums and whether it declares
    a language. Sums of a level that a page has no value for are zero."""
    def less(total: np.ndarray) -> np.ndarray:
        return np.maximum(total - own, 0)

    prior = less(base) + 1 / own.shape[1]
    prior /= prior.sum(axis=1, keepdims=True)
    for level in LEVELS:
        prior = less(sums[level]) + STRENGTH * prior
        prior /= prior.sum(axis=1, keepdims=True)
    # P(declaration | language): pages of the language that declare so, out of all of them.
    likely = np.where(said[:, None], (less(sums["declared"]) + UNKNOWN) / (less(base) + 1), 1.0)
    post = (own + 1e-12) * prior * likely
    return post / post.sum(axis=1, keepdims=True)


def identify(pages: DataFrame, docs: DataFrame, id_column: str = "page_id", url_column: str = "url",
             markup_column: str = "html") -> DataFrame:
    """One row per page: page_id, lang, confidence, text_lang, declared, host, suffix, trigrams."""
    names, logs = log_likelihoods(trigram_counts(docs))
    host, domain, suffix = address_parts(F.col(url_column))
    slim = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), domain.alias("domain"),
                        suffix.alias("suffix"), F.col(markup_column).alias("_html"))
    if not names:
        none = F.lit(None)
        return slim.select("page_id", none.cast("string").alias("lang"), none.cast("double").alias("confidence"),
                           none.cast("string").alias("text_lang"), none.cast("string").alias("declared"),
                           "host", "suffix", F.lit(0).cast("bigint").alias("trigrams"))
    k = len(names)
    rows = stored(page_texts(slim, logs, "_html", ["page_id", "host", "domain", "suffix"]), "pages")
    base = np.array([x or 0.0 for x in rows.agg(
        *(F.sum(F.element_at("likely", i + 1)) for i in range(k))).first()])
    said = stored(_sums(rows.where("declared IS NOT NULL"), [F.col("declared").alias("_declared")], "likely", k,
                        "declared_sums"), "declared-sums")
    joined = (rows.join(host_sums(rows, k), F.col("host") == F.col("_host"), "left")
              .join(said, F.col("declared") == F.col("_declared"), "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2000):
            def arrays(name: str) -> np.ndarray:
                return np.array([x or [0.0] * k for x in rows_of(batch, name)]).reshape(-1, k)

            own = arrays("likely")
            said = np.array([x is not None for x in rows_of(batch, "declared")], bool)
            post = fused(own, base, {key: arrays(f"{key}_sums") for key in (*LEVELS, "declared")}, said)
            text = [names[i] if n else None
                    for i, n in zip(own.argmax(axis=1), rows_of(batch, "trigrams"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([names[i] for i in post.argmax(axis=1)], pa.string()),
                 pa.array(post.max(axis=1, initial=0)), pa.array(text, pa.string()),
                 *(batch.column(batch.schema.get_field_index(c)) for c in ("declared", "host", "suffix", "trigrams"))],
                names=["page_id", "lang", "confidence", "text_lang", "declared", "host", "suffix", "trigrams"])

    schema = (rows.select("page_id").schema.add("lang", "string").add("confidence", "double")
              .add("text_lang", "string").add("declared", "string").add("host", "string")
              .add("suffix", "string").add("trigrams", "long"))
    return joined.mapInArrow(run, schema)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES = {"op1_language": op1_language}
SQL: dict[str, str] = {}
