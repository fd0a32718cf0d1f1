"""From files to masked lines, statements and tokens.

Everything here is column expressions and running windows over (project_id, file_path). Files are
spread by that key once, before the lines are exploded, and every later window or grouping on the
key or more keeps that layout, so a corpus is shuffled once. One file is one cell (at most 2 GB);
no group is larger than a file.

Masking keeps every character at its place: comments become spaces, a string literal becomes a
double quote followed by single quotes, and names inside simple interpolations stay readable.
A line that starts with a single quote is therefore the inside of a literal. Quantifiers are
possessive throughout, which keeps matching linear and off the call stack on long literals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.text import row_id

KEY = ["project_id", "file_path"]
PAST = Window.unboundedPreceding


def by_file(*order: str):
    return Window.partitionBy(*KEY).orderBy(*(order or ("line_no",)))


def so_far(*order: str):
    return by_file(*order).rowsBetween(PAST, 0)


def before(*order: str):
    return by_file(*order).rowsBetween(PAST, -1)

# How literals and comments look.
_QUOTED = r"""%s(?:[^%s\\\n]++|\\[\s\S])*+(?:%s|(?=\n)|\z)"""
_TRIPLE = r"""%s{3}(?:[^%s\\]++|\\[\s\S]|%s(?!%s{2}))*+(?:%s{3}|\z)"""
_PREFIX = "[rRbBuUfF]{0,2}"
_OPERATOR = r"[(,=:\[!&|?;+>{]"
PYTHON_PIECES = "|".join([
    _PREFIX + _TRIPLE.replace("%s", '"'), _PREFIX + _TRIPLE.replace("%s", "'"),
    _PREFIX + _QUOTED.replace("%s", '"'), _PREFIX + _QUOTED.replace("%s", "'"),
    r"#[^\n]*+",
    r"""(?:\w++(?!["'])|[^\w"'#])++""",
    r"\w++", r"[\s\S]",
])
SCRIPT_PIECES = "|".join([
    _QUOTED.replace("%s", '"'), _QUOTED.replace("%s", "'"),
    r"`(?:[^`\\]++|\\[\s\S])*+(?:`|\z)",
    r"//[^\n]*+", r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)",
    # an operator, any blanks and a regular expression literal; then text without such an operator at its end
    _OPERATOR + r"\s*+/(?![/*])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[a-z]*+",
    r"""(?:[^"'`/(,=:\[!&|?;+>{]++|""" + _OPERATOR + r"(?!\s*+/))++", r"[\s\S]",
])
TOKEN = (r"\s*+(?:[\p{L}_$][\p{L}\p{N}_$]*+|[0-9][\w.]*+|\"'*+|'++|=>|===?|!==?|[<>]=|:=|->|"
         r"\*\*=?|//=?|&&|\|\||\?\?|[-+*/%&|^]=|\?\.|\.{3}|\S)")
OPEN, CLOSE = "([{", ")]}"


def without(text: Column, chars: str) -> Column:
    """The text without some characters; many times cheaper than translate(), which looks up each character."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def spaced(text: Column, chars: str = "\t\r\f") -> Column:
    """The text with blanks in place of some characters."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), chars, text)


BRACKETED = r"[\[({][^\[\](){}]*+[\])}]"  # no brackets inside: what outline() leaves of any depth


def outline(code: Column, level: int) -> Column:
    """The text with all that stands deeper than the brackets of a level filled in, at equal length.

    Brackets up to the level stay, so BRACKETED matches one of that level however deep it nests, and places
    hold for the text itself. Only what stays is joined piece by piece, which keeps long literals linear.
    """
    pieces = F.regexp_extract_all(code, F.lit(r"[\[({]|[\])}]|[^\[\](){}]++"), F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        opens, closes = piece.isin(*OPEN), piece.isin(*CLOSE)
        inside = F.when(closes, F.greatest(state["level"] - 1, F.lit(0))).otherwise(state["level"])
        shown = inside <= level
        return F.struct(
            F.when(opens, inside + 1).otherwise(inside).alias("level"),
            F.when(shown, 0).otherwise(state["hidden"] + F.length(piece)).alias("hidden"),
            F.when(shown, F.concat(state["text"], F.repeat(F.lit("'"), state["hidden"]), piece))
            .otherwise(state["text"]).alias("text"))

    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("hidden"), F.lit("").alias("text"))
    filled = F.aggregate(pieces, start, step, lambda s: F.concat(
        s["text"], F.repeat(F.lit("'"), s["hidden"])))
    nested = code.rlike(r"[\[({][^\[\](){}]*+[\[({]")
    return F.when(nested, filled).otherwise(code)


def _fill(text: Column, char: str) -> Column:
    return F.regexp_replace(text, r"[^\n]", char)


def _literal(piece: Column, hole: str, kept: Column) -> Column:
    """A string literal as quotes; `kept` interpolations (opened by `hole`) stay readable."""
    plain = F.concat(F.lit('"'), _fill(F.substring(piece, 2, 1 << 30), "'"))
    parts = F.regexp_extract_all(F.substring(piece, 2, 1 << 30), F.lit(hole), F.lit(0))

    def show(q: Column) -> Column:
        lead = F.length(F.regexp_extract(q, r"^\$?\{", 0))
        name = F.regexp_extract(q, r"^\$?\{([\w$.()\[\], +*-]*+)", 1)
        level = (F.length(F.translate(name, "([", "")) == F.length(F.translate(name, ")]", "")))
        ok = (lead > 0) & (F.length(name) > 0) & level
        return F.when(ok, F.concat(F.repeat(F.lit("'"), lead), name, F.repeat(
            F.lit("'"), F.length(q) - lead - F.length(name)))).otherwise(_fill(q, "'"))

    return F.when(kept, F.concat(F.lit('"'), F.array_join(F.transform(parts, show), ""))
                  ).otherwise(plain)


def _mask(content: str, pieces: str, one: callable) -> Column:
    return F.array_join(F.transform(
        F.regexp_extract_all(F.col(content), F.lit(pieces), F.lit(0)), one), "")


def _python_piece(p: Column) -> Column:
    formatted = p.rlike(r"^[rR]?[fF][rR]?[\"']") & p.contains("{")
    return (F.when(p.rlike(rf"^{_PREFIX}[\"']"), _literal(
        p, r"\{\{|\{[^{}\n\"']*+\}|[^{}]++|[\s\S]", formatted))
        .when(p.startswith("#"), _fill(p, " ")).otherwise(p))


def _script_piece(p: Column) -> Column:
    lead = F.length(F.regexp_extract(p, rf"^{_OPERATOR}\s*+", 0))  # of what stands before a literal
    return (F.when(p.rlike(r"^[\"'`]"), _literal(
        p, r"\$\{[^{}\n\"'`]*+\}|[^$]++|[\s\S]", p.startswith("`") & p.contains("${")))
        .when(p.rlike(r"^/[/*]"), _fill(p, " "))
        .when(p.rlike(rf"^{_OPERATOR}\s*+/"), F.concat(
            F.left(p, lead), _literal(F.substring(p, lead + 1, F.lit(1 << 30)), r"[\s\S]", F.lit(False))))
        .otherwise(p))


BYTES_PER_TASK = 2 << 20
MAX_TASKS = 100_000


def text_bytes(files: DataFrame) -> int:
    """The bytes of all contents, by one pass over the files that moves none of them."""
    return files.agg(F.sum(F.octet_length("content").cast("bigint"))).first()[0] or 0


def key_numbers() -> list[Column]:
    """Two numbers for the key of a file: 128 bits of hashes of it, which tell a null apart."""
    empty = [F.col(k).isNull() for k in KEY]
    return [F.xxhash64(*empty, *KEY), F.xxhash64(F.lit("file"), *empty, *reversed(KEY))]


def numbered(files: DataFrame) -> DataFrame:
    """Files with the two numbers of key_numbers() in place of their key.

    All lines, statements and tokens carry the key of their file and are sorted by it again and again; numbers
    keep these rows short, and the first of them nearly always decides the order. named() gives the keys back.
    """
    return files.withColumns(dict(zip(KEY, key_numbers(), strict=True)))


CARRIED = "_file"


def carrying(files: DataFrame) -> DataFrame:
    """numbered() files whose rows carry the key along, for rows that are few a file: restored() needs no join."""
    return numbered(files.withColumn(CARRIED, F.struct(*KEY)))


def carried(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c == CARRIED]


def restored(rows: DataFrame) -> DataFrame:
    """Rows of carrying() files with the keys of these files."""
    return rows.select(f"{CARRIED}.*", *[c for c in rows.columns if c not in (*KEY, CARRIED)])


def file_keys(files: DataFrame, size: int) -> DataFrame:
    """The numbers of numbered() with the keys they stand for, one row each, laid out as spread() does."""
    keys = numbered(files.select(*KEY, *[F.col(k).alias(f"_{k}") for k in KEY]))
    return _dealt(keys, size).dropDuplicates(KEY)


def named(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of numbered() files with the keys of these files; neither side moves for it.

    Estimates of a plan make computed rows small whatever the corpus, and Spark would send all of them through the
    driver to every task. Both sides are dealt alike, so each task looks its rows up among the keys of its own files.
    """
    return rows.join(keys.hint("shuffle_hash"), KEY).select(*[F.col(f"_{k}").alias(k) for k in KEY], *[c for c in rows.columns if c not in KEY])


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    floor = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(floor, min(size // BYTES_PER_TASK, MAX_TASKS)), *KEY)


def spread(files: DataFrame, size: int) -> DataFrame:
    """Files laid out by key, in a number of tasks that follows the size of their text.

    Tokens take some sixty times the bytes of the text, and a task sorts them several times over, so its
    share of the text must stay small for them to stay in memory. Coalescing only sees the bytes
    shuffled, and the estimates of a plan say little of texts that it computes, so the size is counted.
    """
    return _dealt(files.select(*KEY, *carried(files), "language", "content"), size)


def lines(files: DataFrame, family: str) -> DataFrame:
    """One row per line: number, raw text, masked code, the bracket depth before it, in `passed` the width
    of the lines before it without the blanks at their ends, and in `goes_on` whether the line before it runs on."""
    mask = (_mask("content", PYTHON_PIECES, _python_piece) if family == "python"
            else _mask("content", SCRIPT_PIECES, _script_piece))
    rows = (files.select(*KEY, *carried(files), "language", F.posexplode(F.arrays_zip(
        F.split("content", "\n", -1).alias("line"), F.split(mask, "\n", -1).alias("code")))))
    rows = rows.select(*KEY, *carried(rows), "language", (F.col("pos") + 1).alias("line_no"),
                       "col.line", "col.code")
    delta = F.length(without(F.col("code"), CLOSE)) - F.length(without(F.col("code"), OPEN))
    code = F.rtrim("code")
    width = F.length(F.when(F.ascii(F.substring(code, -1, 1)) <= ord(" "), F.regexp_replace(code, r"(?<!\s)\s++$", ""))
                     .otherwise(code))
    runs_on = F.col("code").rlike(r"\\\s*$" if family == "python" else r"\\\s*$|" + _RUNS_ON)
    return rows.select("*", F.coalesce(F.sum(delta).over(before()), F.lit(0)).cast("int").alias("depth"),
                       F.coalesce(F.lag(runs_on).over(by_file()), F.lit(False)).alias("goes_on"),
                       F.coalesce(F.sum(width).over(by_file().rangeBetween(PAST, -1)), F.lit(0)).alias("passed"))


def module_scopes(files: DataFrame) -> DataFrame:
    """The outermost scope of each file, from its first to its last line."""
    newlines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return files.select(
        row_id(*KEY, F.lit("module")).alias("scope_id"), *KEY,
        F.lit(None).cast("string").alias("parent_scope_id"), F.lit("module").alias("kind"),
        F.lit(None).cast("string").alias("name"), F.lit(1).alias("start_line"),
        (newlines + 1).alias("end_line"), F.lit(0).alias("depth"))


# Statement kinds by what their first line looks like.
_PYTHON_KINDS = [
    ("def", r"^\s*(?:async\s+def|def|class)\s+\w"),
    ("import", r"^\s*(?:import|from)\s"),
    ("decorator", r"^\s*@"),
    ("string", r"^\s*\"'*\s*$"),
    ("all", r"^\s*__all__\s*(?::[^=]*)?=\s*\["),
    ("assign", r"^\s*(?!(?:else|try|finally|lambda|if|elif|for|while|with|except|match|case)\b)"
               r"(?:\p{Lu}[\w]*\s*=(?!=)|[\p{L}_][\w.]*(?:\[[^\]]*\])?\s*:(?!=)\s*\S)"),
]
_SCRIPT_KINDS = [
    ("import", r"^\s*import\b(?!\s*[(.])"),
    ("export", r"^\s*export\s*(?:\{|default\b|type\s*\{)"),
    ("alias", r"^\s*(?:export\s+)?(?:declare\s+)?type\s+[\w$]+\s*(?:<.*)?="),
    ("interface", r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+[\w$]+"),
]
_HANGS_ON = r"^\s*(?:[|&?:=+*/%<>.,)\]}]|\|\|)"
_RUNS_ON = r"(?:[=|&,(+*/%<>?:\[{-]|\bfrom|\bimport|\bexport)\s*$"


def statements(line_rows: DataFrame, family: str) -> DataFrame:
    """Logical statements at bracket depth zero, in order.

    Text is kept only for the kinds the rules use. last_line and last_col locate the end of the
    last line with code on it.
    """
    code = F.col("code")
    indent = F.length(F.regexp_extract(code, r"^[ \t\f]*", 0))
    rows = line_rows.withColumns({"_width": F.length(F.rtrim(spaced(code))), "_indent": indent})
    goes_on = F.col("goes_on")
    if family != "python":
        goes_on = goes_on | code.rlike(_HANGS_ON)
    starts = (F.col("_width") > 0) & (F.col("depth") == 0) & ~code.startswith("'") & ~goes_on
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(_PYTHON_KINDS if family == "python" else _SCRIPT_KINDS):
        kind = F.when(code.rlike(pattern), name).otherwise(kind)
    rows = rows.withColumn("_start", F.when(starts, F.struct(
        "line_no", kind.alias("kind"), F.col("_indent").alias("indent"))))
    rows = rows.withColumn("_s", F.last("_start", True).over(so_far())).where("_s is not null")
    end = F.when(F.col("_width") > 0, F.struct(
        F.col("line_no").alias("line"),
        F.octet_length(F.left("line", F.col("_width"))).alias("col")))
    text = F.when(F.col("_s.kind").isNotNull(), F.struct("line_no", "line", "code"))
    grouped = rows.groupBy(*KEY, *carried(rows), "language", F.col("_s.line_no").alias("line_no")).agg(
        F.max("_s.kind").alias("kind"), F.max("_s.indent").alias("indent"),
        F.max(end).alias("last"), F.sort_array(F.collect_list(text)).alias("rows"))
    return grouped.select(
        *KEY, *carried(rows), "language", "line_no", "kind", "indent",
        F.col("last.line").alias("last_line"), F.col("last.col").alias("last_col"),
        F.array_join("rows.line", "\n").alias("raw"),
        F.array_join("rows.code", "\n").alias("code"), "rows")


def raw_slice(offset: Column, length: Column) -> Column:
    """The raw text at a place found in the masked text of the same statement."""
    return F.substring(F.col("raw"), offset + 1, length)


TOKEN_ORDER = ("line_no", "idx")


def tokens(line_rows: DataFrame, own: dict[str, Column] | None = None,
           around: dict[str, Column] | None = None) -> DataFrame:
    """Tokens with place, bracket step and level, ordered within a file by (line_no, idx).

    `own` are columns made of `tok`, and `around` windows over by_file(*TOKEN_ORDER) on these; they are worked out in
    the pass that finds the places, as each pass copies all tokens.

    A bracket and its partner share one level: the depth outside them. Byte columns differ from
    character columns only on lines with non-ASCII text, and only those carry their raw text.
    """
    wide = F.when(F.octet_length("line") != F.length("line"), F.col("line"))
    rows = line_rows.select(*KEY, *carried(line_rows), "language", "line_no", "passed", wide.alias("_wide"), F.posexplode(
        F.regexp_extract_all("code", F.lit(TOKEN), F.lit(0))).alias("idx", "_piece"))
    rows = rows.select(*KEY, *carried(rows), "language", "line_no", "idx", "_wide", "passed", F.length("_piece")
                       .alias("_width"), F.ltrim("_piece").alias("tok"))
    other = F.ascii("tok") < ord(" ")  # tabs and the like
    rows = rows.withColumn("tok", F.when(other, F.regexp_extract("tok", r"^\s*+([\s\S]*)$", 1)).otherwise(F.col("tok")))
    delta = F.when(F.col("tok").isin(*OPEN), 1).when(F.col("tok").isin(*CLOSE), -1).otherwise(0)
    # Pieces leave out no more than the blanks that end a line, so one running sum of the file tells the column.
    upto = so_far(*TOKEN_ORDER)
    own, around = own or {}, around or {}
    rows = rows.withColumns({"delta": delta, **own}).select(
        "*", (F.sum("_width").over(upto) - F.col("passed")).cast("int").alias("_end"),
        F.sum("delta").over(upto).cast("int").alias("_depth"), *[c.alias(n) for n, c in around.items()])
    char_col = F.col("_end") - F.length("tok")
    return rows.select(
        *KEY, *carried(rows), "language", "line_no", "idx", "tok", "delta",
        F.coalesce(F.octet_length(F.left("_wide", char_col)), char_col).alias("col"),
        F.coalesce(F.octet_length(F.left("_wide", F.col("_end"))), F.col("_end")).alias("end_col"),
        F.when(F.col("delta") == 1, F.col("_depth") - 1).otherwise(F.col("_depth"))
        .alias("level"), *own, *around)
