"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_id(*parts: str | Column) -> Column:
    """Deterministic id from the parts that identify a row."""
    cols = [F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"),
                       F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\u0001", *cols), 256)


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("bigint")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def occurrences(haystack: Column, needle: str) -> Column:
    """How often a non-empty text occurs, without overlaps."""
    cut = F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))
    return F.floor(cut / len(needle)).cast("bigint")


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression that may start at any folder."""
    out, i = "(^|/)", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if not glob[i].isalnum() else glob[i]), i + 1
    return out + "$"
