"""What a file path says: language, document type, format, title."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelake.functions.text import glob_pattern, strip

# File extensions per language and the default document patterns.
LANGUAGES = {
    ".py": "python",
    ".pyi": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
}
DOCUMENT_PATTERNS = ["README*", "*.md", "*.markdown", "*.rst", "*.txt", "CONTRIBUTING*",
                     "CHANGELOG*", "LICENSE*", "docs/**/*"]


def language_of(path: str) -> Column:
    """Language by extension, NULL when unknown."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return table[F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)]


def matches_any(path: str, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(path).rlike(glob_pattern(g)) for g in globs])


def file_name(path: str) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def document_type(path: str) -> Column:
    name = F.lower(file_name(path))
    rule = F.when(name.startswith("readme"), "readme")
    for kind in ("contributing", "changelog", "license"):
        rule = rule.when(name.startswith(kind), kind)
    return (rule.when(name.contains("api"), "api")
            .when(name.contains("guide") | name.contains("tutorial"), "guide")
            .when(F.col(path).rlike(r"(^|/)docs/[^/]*$"), "documentation")
            .otherwise("general"))


def document_format(path: str) -> Column:
    """The suffix without its dot; a name that only starts with a dot has none."""
    suffix = F.regexp_extract(file_name(path), r"[^.].*\.([^.]+)$", 1)
    short = F.regexp_extract(file_name(path), r"^[^.]\.([^.]+)$", 1)
    return F.coalesce(F.nullif(suffix, F.lit("")), F.nullif(short, F.lit("")), F.lit("txt"))


def document_title(content: str, path: str) -> Column:
    """First heading among the first ten lines, else the file stem in title case."""
    lines = F.split(F.substring_index(content, "\n", 10), "\n", -1)
    stripped = F.transform(lines, strip)

    def title_at(line: Column, i: Column) -> Column:
        heading = strip(F.regexp_replace(line, r"^[# ]+", ""))
        underlined = line.startswith("=") & (F.length(line) > 3) & (i > 0)
        return (F.when(line.startswith("# "), heading)
                .when(underlined, F.try_element_at(stripped, F.greatest(i, F.lit(1)))))

    found = F.filter(F.transform(stripped, title_at), lambda t: t.isNotNull())
    stem = F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.try_element_at(found, F.lit(1)),
                      F.initcap(F.translate(stem, "-_", "  ")))
