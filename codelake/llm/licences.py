"""License scans by canonical digest lookup.

A text is brought into a canonical form: ASCII lower case, copyright lines dropped, punctuation to
blanks, equivalent spellings to one, runs of blanks to one. Its SHA-256 is joined with the digests
of known licence texts, so a text matches when all of it is a known licence. The same lookup of
each line finds the one-line notices that stand inside longer documents. Everything is built from
DataFrame functions; the known digests are broadcast while they are few.

Edge cases: a null text counts as empty; the empty form matches nothing. Very long texts are read
whole. Rows that share an id are scanned one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import stored, table

#: Known digests that are broadcast to every task; more are joined by a shuffle.
BROADCAST_ROWS = 100_000

# Spellings that mean the same, as (written, canonical), each a whole word.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("behaviour", "behavior"), ("cancelled", "canceled"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("honour", "honor"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"),
    ("licences", "licenses"), ("modelling", "modeling"), ("organisation", "organization"),
    ("organise", "organize"), ("programme", "program"), ("recognise", "recognize"),
    ("sublicence", "sublicense"), ("unauthorised", "unauthorized"), ("utilise", "utilize"),
    ("whilst", "while"), ("wilful", "willful"), ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"), ("non commercial", "noncommercial"),
    ("per cent", "percent"), ("sub license", "sublicense")]

# Notices and short licences, as (name, text).
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
            "without fee is hereby granted, provided that the above copyright notice and this permission "
            "notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
            "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
            "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
            "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
            "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
             "without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
             "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
             "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
             "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
             "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
             "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files (the \"Software\"), to deal in the Software without "
            "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright "
            "notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
            "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
            "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
            "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
            "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will "
             "the authors be held liable for any damages arising from the use of this software.\n\n"
             "Permission is granted to anyone to use this software for any purpose, including commercial "
             "applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions:\n\n1. The origin of this software must not be misrepresented; you must not "
             "claim that you wrote the original software. If you use this software in a product, an "
             "acknowledgment in the product documentation would be appreciated but is not required.\n"
             "2. Altered source versions must be plainly marked as such, and must not be misrepresented "
             "as being the original software.\n3. This notice may not be removed or altered from any "
             "source distribution.")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
# Runs of ASCII blanks and punctuation.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CURLY = "‘’“”–—…•"


def canonical(text: Column) -> Column:
    """The form in which texts are compared; words stand between single blanks, also at both ends."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    kept = F.regexp_replace(lower, COPYRIGHT_LINE, "\n")
    words = F.regexp_replace(F.translate(F.concat(F.lit(" "), kept, F.lit(" ")), CURLY, " " * len(CURLY)),
                             BREAKS, " ")
    return reduce(lambda c, pair: F.replace(c, F.lit(f" {pair[0]} "), F.lit(f" {pair[1]} ")), SPELLINGS, words)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(texts: DataFrame) -> DataFrame:
    """(digest, licence) of known texts (licence, text); of several names the first counts."""
    return (texts.where(canonical(F.col("text")) != " ").groupBy(digest(F.col("text")).alias("digest"))
            .agg(F.min("licence").alias("licence")))


def licence_scan(docs: DataFrame, known: DataFrame, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, text_digest, licence of the whole text, and of its lines the
    number that are known (notice_lines) and their licences, sorted and joined by commas (notices)."""
    known = stored(known, "known-licences")
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    # The number of a row only has to tell the rows of this one job apart.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"),
                       digest(F.col(text_column)).alias("text_digest"),
                       F.split(F.coalesce(F.col(text_column), F.lit("")), "\n").alias("lines"))
    lines = (rows.select("row", "doc_id", "text_digest", F.explode("lines").alias("line"))
             .withColumn("digest", F.when(F.length("line") > 0, digest(F.col("line")))).drop("line")
             .join(known.withColumnRenamed("licence", "notice"), "digest", "left"))
    found = lines.groupBy("row", "doc_id", "text_digest").agg(
        F.count("notice").alias("notice_lines"),
        F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"))
    whole = known.withColumnRenamed("digest", "text_digest")
    return found.join(whole, "text_digest", "left").select(
        "doc_id", "text_digest", "licence", "notice_lines", "notices")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = known_digests(spark.createDataFrame(NOTICES, "licence string, text string"))
    return licence_scan(table(spark, sf_dir, "documents"), known)


def _sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in NOTICES)
    spelled = reduce(lambda c, p: f"replace({c}, ' {p[0]} ', ' {p[1]} ')", SPELLINGS,
                     f"""regexp_replace(translate(' ' || regexp_replace(translate(coalesce(t, ''),
                     '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', chr(10), 'g') || ' ', '{CURLY}',
                     '{" " * len(CURLY)}'), '{BREAKS}', ' ', 'g')""")
    return f"""
WITH known_texts(licence, text) AS (VALUES {values}),
forms AS (
  SELECT 'k' AS kind, NULL AS doc_id, licence, text AS t FROM known_texts
  UNION ALL SELECT 'd', doc_id, NULL, text FROM documents
  UNION ALL SELECT 'l', doc_id, NULL, unnest(string_split(text, chr(10))) FROM documents),
digests AS (SELECT kind, doc_id, licence, {spelled} AS form, sha256(form) AS digest FROM forms
            WHERE kind = 'd' OR length(t) > 0),
known AS (SELECT digest, min(licence) AS licence FROM digests WHERE kind = 'k' AND form <> ' ' GROUP BY 1),
lines AS (SELECT l.doc_id, count(*) AS notice_lines,
                 array_to_string(list_sort(list(DISTINCT known.licence)), ',') AS notices
          FROM digests l JOIN known USING (digest) WHERE l.kind = 'l' GROUP BY 1)
SELECT d.doc_id, d.digest AS text_digest, known.licence, coalesce(notice_lines, 0) AS notice_lines,
       coalesce(notices, '') AS notices
FROM digests d LEFT JOIN known USING (digest) LEFT JOIN lines ON lines.doc_id = d.doc_id
WHERE d.kind = 'd'"""


QUERIES = {"op2_licences": op2_licences}
SQL = {"op2_licences": _sql()}
