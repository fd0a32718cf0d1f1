"""Python symbols, types, imports, exports, scopes and references as queries over statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.text import row_id
from codelake.plans.lines import (BRACKETED, KEY, PAST, TOKEN_ORDER, before, by_file, carried,
                                  module_scopes, outline, raw_slice, tokens)

# Reserved words, which are not references.
KEYWORDS = ["False", "None", "True", "and", "as", "assert", "async", "await", "break", "class",
            "continue", "def", "del", "elif", "else", "except", "finally", "for", "from",
            "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass",
            "raise", "return", "try", "while", "with", "yield"]
_BLOCK_WORDS = ["if", "elif", "else", "for", "while", "try", "except", "finally", "with"]
_HEAD = r"^\s*(?:async\s+)?(?:def|class)\s+[\p{L}_][\p{L}\p{N}_]*+\s*+(?:\[[^\]]*+\]\s*+)?"
_PART = r"(?:[^,\[\](){}]++|" + BRACKETED + r")++"


def visibility(name: Column) -> Column:
    return (F.when(name.startswith("__") & ~name.endswith("__"), "private")
            .when(name.startswith("_"), "protected").otherwise("public"))


def _signature() -> Column:
    """Name, raw parameter text and return type; classes list their plain base names."""
    outer = outline(F.col("code"), 0)
    head = F.length(F.regexp_extract(outer, _HEAD, 0))
    args = F.length(F.regexp_extract(outer, _HEAD + "(" + BRACKETED + ")", 1))
    rest = F.substring(outer, head + args + 1, F.lit(1 << 30))
    arrow = F.length(F.regexp_extract(rest, r"^\s*->\s*", 0))
    returns = F.length(F.rtrim(F.regexp_extract(
        rest, r"^\s*->\s*((?:[^:\[\](){}]++|" + BRACKETED + ")++)", 1)))
    function = F.concat(
        F.col("name"), raw_slice(head, args),
        F.when(returns > 0, F.concat(F.lit(" -> "), raw_slice(head + args + arrow, returns)))
        .otherwise(""))
    inner = F.regexp_replace(F.substring(outline(F.col("code"), 1), head + 2, args - 2), BRACKETED, "()")
    bases = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(F.translate(
        x, "\n\t\r", "   "))), lambda x: x.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"))
    plain = F.concat(F.lit("class "), F.col("name"))
    type_ = F.when(F.size(bases) > 0, F.concat(
        plain, F.lit("("), F.array_join(bases, ", "), F.lit(")"))).otherwise(plain)
    return F.when(F.col("is_class"), type_).otherwise(function)


def _unquote(raw: Column) -> Column:
    return F.regexp_replace(raw, "^[\"']+|[\"']+$", "")


def definitions(statements: DataFrame) -> DataFrame:
    """Functions, methods and classes with their span, parent chain, docstring and decorators.

    A statement closes every open definition whose indent is not below its own. Each statement is
    therefore placed under the definition indents of its file it closes, and each definition also
    under the smaller ones, as a probe. Within (file, indent) in line order, the next closing row
    gives the end, and the last closing row before a probe is an ancestor when it is a
    definition. A body line appears under no indent, so the placed rows stay few.
    """
    is_def = F.col("kind") == "def"
    runs = F.sum(F.when(F.col("kind") == "decorator", 0).otherwise(1)).over(before())
    whole = by_file().rowsBetween(PAST, Window.unboundedFollowing)  # in the order of the others, so one pass does all
    rows = statements.select(
        *KEY, *carried(statements), "language", "line_no", "kind", "indent", "last_line", "last_col",
        F.when(is_def, F.col("raw")).alias("raw"), F.when(is_def, F.col("code")).alias("code"),
        F.when(F.col("kind") == "decorator", F.rtrim(raw_slice(
            F.col("indent"), F.length(F.rtrim("code")) - F.col("indent")))).alias("_deco"),
        F.coalesce(runs, F.lit(0)).alias("_run"),
        F.lead(F.when(F.col("kind") == "string", F.struct("indent", "raw", "code"))).over(by_file()).alias("_next"),
        F.lag(F.struct("last_line", "last_col")).over(by_file()).alias("_ended"),
        F.max(F.struct("last_line", "last_col")).over(whole).alias("_eof"),
        F.collect_set(F.when(is_def, F.col("indent"))).over(whole).alias("_indents"))
    # The others would be placed under no indent below, and are no part of a run of decorators.
    rows = rows.where((F.col("indent") <= F.array_max("_indents")) | F.col("kind").eqNullSafe("decorator"))
    run = Window.partitionBy(*KEY, "_run").orderBy("line_no")
    rows = rows.withColumn("_decos", F.collect_list("_deco").over(run.rowsBetween(PAST, 0)))
    doc = F.when(F.col("_next.indent") > F.col("indent"),
                 _unquote(F.trim(F.substring(F.col("_next.raw"), F.lit(1), F.length(
                     F.rtrim(F.translate("_next.code", "\n\r", "  ")))))))
    name = F.regexp_extract("code", r"^\s*(?:async\s+)?(?:def|class)\s+([\p{L}_][\p{L}\p{N}_]*)", 1)
    rows = rows.select(
        *KEY, *carried(rows), "line_no", "indent", "_ended", "_eof", is_def.alias("is_def"),
        F.when(is_def, F.struct(
            "language", name.alias("name"),
            F.col("code").rlike(r"^\s*class\b").alias("is_class"),
            F.col("code").rlike(r"^\s*async\b").alias("is_async"),
            doc.alias("docstring"), F.col("_decos").alias("decorators"), "raw", "code")).alias("d"),
        F.explode(F.filter("_indents", lambda i: (i >= F.col("indent")) | is_def)).alias("level"))
    closes = F.col("level") >= F.col("indent")
    at_level = Window.partitionBy(*KEY, "level").orderBy("line_no")
    owner = F.when(closes, F.struct(
        (F.col("is_def") & (F.col("indent") == F.col("level"))).alias("opens"),
        "level", "line_no", F.col("d.name").alias("name"), F.col("d.is_class").alias("is_class")))
    placed = rows.withColumn("_closing", F.when(closes, F.col("_ended"))).select(
        *KEY, *carried(rows), "line_no", "indent", "level", "d", "_eof",
        F.last(owner, True).over(at_level.rowsBetween(PAST, -1)).alias("_owner"),
        F.expr("lead(_closing) IGNORE NULLS").over(at_level).alias("_end")).where("d is not null")
    own = F.col("level") == F.col("indent")
    found = placed.groupBy(*KEY, *carried(placed), "line_no").agg(
        F.max("indent").alias("indent"), F.first("d").alias("d"),
        F.max(F.when(own, F.coalesce("_end", "_eof"))).alias("end"),
        F.sort_array(F.collect_list(F.when(
            F.col("_owner.opens") & (F.col("level") < F.col("indent")), F.col("_owner"))))
        .alias("chain"))
    parent = F.try_element_at("chain", F.lit(-1))
    return found.select(
        *KEY, *carried(found), "d.language", "d.name", "d.is_class", "d.is_async", "d.docstring", "d.decorators",
        "d.raw", "d.code",
        F.col("line_no").alias("start_line"), F.col("end.last_line").alias("end_line"),
        F.col("indent").alias("start_col"), F.col("end.last_col").alias("end_col"),
        (F.size("chain") + 1).alias("depth"),
        parent["line_no"].alias("parent_line"), parent["name"].alias("parent_name"),
        parent["is_class"].alias("in_class"),
        F.array_join(F.concat("chain.name", F.array("d.name")), ".").alias("qualified_name"))


def symbol_id(line: str = "start_line", name: str = "name") -> Column:
    return F.when(F.col(line).isNotNull(), row_id(*KEY, name, line))


def scope_id(line: str, name: str) -> Column:
    return F.when(F.col(line).isNotNull(), row_id(*KEY, F.lit("scope"), name, line))


def symbols(d: DataFrame) -> DataFrame:
    """Rows of the symbols table from definitions()."""
    kind = (F.when(F.col("is_class"), "class")
            .when(F.coalesce("in_class", F.lit(False)), "method").otherwise("function"))
    return d.select(
        symbol_id().alias("symbol_id"), *KEY, "name", "qualified_name", kind.alias("kind"),
        visibility(F.col("name")).alias("visibility"), "start_line", "end_line", "start_col",
        "end_col", symbol_id("parent_line", "parent_name").alias("parent_symbol_id"),
        scope_id("start_line", "name").alias("scope_id"), "docstring",
        _signature().alias("signature"), "is_async", F.lit(False).alias("is_static"),
        "decorators", F.lit("{}").alias("metadata"))


def scopes(d: DataFrame, files: DataFrame) -> DataFrame:
    """The module of each file and one scope per definition."""
    inner = d.select(
        scope_id("start_line", "name").alias("scope_id"), *KEY,
        F.coalesce(scope_id("parent_line", "parent_name"), row_id(*KEY, F.lit("module")))
        .alias("parent_scope_id"),
        F.when(F.col("is_class"), "class").otherwise("function").alias("kind"),
        "name", "start_line", "end_line", "depth")
    return module_scopes(files).unionByName(inner)


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def types(statements: DataFrame) -> DataFrame:
    """Aliases (`Upper = expr`) and every variable, parameter and return annotation."""
    used = statements.where("kind in ('def', 'assign')").withColumn(
        "code", F.regexp_replace("code", r"[ \t\r\n\f]+$", ""))
    used = used.withColumns({"_outer": outline(F.col("code"), 0), "_inner": outline(F.col("code"), 1)})
    name_part = r"^\s*(\p{Lu}\w*)"
    before_value = name_part + r"\s*(?::(?:[^=\[\](){}]++|" + BRACKETED + r")++)?=(?!=)\s*"
    value_at = F.length(F.regexp_extract("_outer", before_value, 0))
    alias = F.when(value_at > 0, F.array(F.struct(
        F.regexp_extract("code", name_part, 1).alias("name"), F.lit("alias").alias("kind"),
        value_at.alias("at"), (F.length("code") - value_at).alias("width"))))
    target = r"^\s*[\p{L}_][\w.]*(?:\[[^\]]*\])?\s*:(?!=)\s*"
    note = r"((?:[^=\[\](){}]++|" + BRACKETED + ")++)"
    var_at = F.length(F.regexp_extract("_outer", target, 0))
    variable = F.when((var_at > 0) & (F.col("kind") == "assign"), F.array(_note(
        var_at, F.length(F.rtrim(F.regexp_extract("_outer", target + note, 1))))))
    head = F.length(F.regexp_extract("_outer", _HEAD, 0))
    args = F.length(F.regexp_extract("_outer", _HEAD + "(" + BRACKETED + ")", 1))
    parts = F.regexp_extract_all(F.substring(F.col("_inner"), head + 2, args - 2), F.lit(_PART), F.lit(0))

    def parameter(p: Column, i: Column) -> Column:
        start = head + 1 + i + F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0),
                                           lambda a, x: a + F.length(x))
        own = r"^\s*\*{0,2}\s*[\p{L}_]\w*\s*:\s*"
        lead = F.length(F.regexp_extract(p, own, 0))
        width = F.length(F.regexp_replace(F.regexp_extract(p, own + note, 1), r"\s+$", ""))
        return F.when((lead > 0) & (width > 0), _note(start + lead, width))

    is_function = (F.col("kind") == "def") & ~F.col("code").rlike(r"^\s*class\b")
    params = F.when(is_function & (args > 2), F.filter(
        F.transform(parts, parameter), lambda x: x.isNotNull()))
    rest = F.substring(F.col("_outer"), head + args + 1, F.lit(1 << 30))
    arrow = F.length(F.regexp_extract(rest, r"^\s*->\s*", 0))
    width = F.length(F.rtrim(F.regexp_extract(
        rest, r"^\s*->\s*((?:[^:\[\](){}]++|" + BRACKETED + ")++)", 1)))
    returned = F.when(is_function & (arrow > 0),
                      F.array(_note(head + args + arrow, width)))
    none = F.expr("cast(array() as array<struct<name string, kind string, at int, width int>>)")
    rows = used.select(*KEY, "line_no", "raw", "code", F.explode(F.concat(*[
        F.coalesce(x, none) for x in (alias, variable, params, returned)])).alias("t"))
    start = F.col("line_no") + _newlines(F.left("code", F.col("t.at")))
    end = F.col("line_no") + _newlines(F.left("code", F.col("t.at") + F.col("t.width")))
    return rows.select(
        row_id(*KEY, "t.kind", "t.name", "line_no", "t.at").alias("type_id"), *KEY,
        F.lit(None).cast("string").alias("symbol_id"), "t.name", "t.kind",
        raw_slice(F.col("t.at"), F.col("t.width")).alias("type_expression"),
        F.when(F.col("t.kind") == "alias", F.col("line_no")).otherwise(start).alias("start_line"),
        end.alias("end_line"), F.lit(False).alias("is_generic"),
        F.array().cast("array<string>").alias("generic_params"), F.lit("{}").alias("metadata"))


def _note(at: Column, width: Column) -> Column:
    return F.struct(F.lit("").alias("name"), F.lit("annotation").alias("kind"),
                    at.alias("at"), width.alias("width"))


def imports(statements: DataFrame) -> DataFrame:
    """One row per module of `import`, one per `from` statement with its names."""
    text = F.trim(F.regexp_replace(F.regexp_replace("code", r"\\?[\r\n]|[()\t]", " "), ";.*$", ""))
    rows = statements.where("kind = 'import'").select(*KEY, "line_no", text.alias("t"))
    from_ = r"^from\s+([.\s]*[\w.]*)\s+import\b\s*(.*)$"
    module = F.regexp_replace(F.regexp_extract("t", from_, 1), r"\s", "")
    names = F.filter(F.transform(F.split(F.regexp_extract("t", from_, 2), ","),
                                 lambda x: F.regexp_extract(x, r"^\s*([^\s*]+)", 1)),
                     lambda x: x != "")
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    no_names = F.array().cast("array<string>")
    one = F.array(F.struct(module.alias("module_path"), names.alias("imported_names"),
                           F.lit(None).cast("string").alias("alias"),
                           dots.alias("relative_level"), F.lit("from_import").alias("import_kind")))
    many = F.transform(
        F.split(F.regexp_extract("t", r"^import\s+(.*)$", 1), ","),
        lambda x: F.struct(
            F.regexp_extract(x, r"^\s*([\w.]+)", 1).alias("module_path"),
            no_names.alias("imported_names"),
            F.nullif(F.regexp_extract(x, r"\sas\s+(\w+)", 1), F.lit("")).alias("alias"),
            F.lit(0).alias("relative_level"), F.lit("import").alias("import_kind")))
    rows = rows.select(*KEY, "line_no", F.posexplode(
        F.when(F.col("t").startswith("from"), one).otherwise(many)).alias("i", "m"))
    rows = rows.where("m.module_path != '' and m.module_path != '__future__'")
    return rows.select(
        row_id(*KEY, "m.module_path", "line_no", "i").alias("import_id"), *KEY, "m.module_path",
        "m.imported_names", "m.alias", (F.col("m.relative_level") > 0).alias("is_relative"),
        "m.relative_level", "m.import_kind", F.col("line_no").alias("start_line"),
        F.lit(False).alias("is_type_only"))


def exports(statements: DataFrame) -> DataFrame:
    """The strings of an `__all__` list, each with its own line."""
    kept = F.left("r.line", F.length(F.rtrim(F.translate("r.code", "\t\r", "  "))))
    rows = (statements.where("kind = 'all'").select(*KEY, F.explode("rows").alias("r"))
            .select(*KEY, F.col("r.line_no").alias("start_line"), F.explode(F.regexp_extract_all(
                kept, F.lit(r"\"[^\"]*\"|'[^']*'"), F.lit(0))).alias("quoted")))
    name = _unquote(F.col("quoted"))
    return rows.select(
        row_id(*KEY, "quoted", "start_line").alias("export_id"), *KEY,
        F.lit(None).cast("string").alias("symbol_id"), name.alias("exported_name"),
        F.lit(None).cast("string").alias("original_name"),
        F.lit("direct").alias("export_kind"), "start_line")


def referring_tokens(line_rows: DataFrame) -> DataFrame:
    """Tokens with the ones before and after them, and whether a line starts."""
    w = by_file(*TOKEN_ORDER)
    return tokens(line_rows, around={
        "prev": F.lag("tok").over(w), "next": F.lead("tok").over(w),
        "_new": F.coalesce(F.lag("line_no").over(w) != F.col("line_no"), F.lit(True))})


def references(t: DataFrame, keyed: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Every identifier of referring_tokens(): call when called by its bare name, write when assigned, else read.
    `keyed` gives the rows the keys of their files, where they are numbered."""
    w = by_file(*TOKEN_ORDER)
    first = F.col("_new") & (F.col("level") == 0) & (F.coalesce("prev", F.lit("")) != "\\")
    t = t.withColumn("_first", first).withColumn(
        "_lead", F.last(F.when(F.col("_first"), F.col("tok")), True).over(w.rowsBetween(PAST, 0)))
    names = t.where(F.col("tok").rlike(r"^[\p{L}_]") & ~F.col("tok").isin(KEYWORDS))
    prev = F.coalesce("prev", F.lit(""))
    head = F.col("_first") | (prev == ";") | (
        (prev == ":") & F.col("_lead").isin(_BLOCK_WORDS))
    assigned = (F.col("level") == 0) & (
        (head & F.col("next").isin("=", ":")) | ((prev == "=") & (F.col("next") == "=")))
    call = (F.col("next") == "(") & ~prev.isin(".", "def", "class")
    kind = F.when(assigned, "write").when(call, "call").otherwise("read")
    found = keyed(names.select(*KEY, *carried(names), "tok", "line_no", "col", F.coalesce(kind, F.lit("read")).alias("kind"),
                               F.coalesce(prev.isin("def", "class"), F.lit(False)).alias("is_definition")))
    return found.select(
        row_id(*KEY, "tok", "line_no", "col").alias("reference_id"), *KEY,
        F.lit(None).cast("string").alias("symbol_id"), F.col("tok").alias("name"), "kind",
        F.col("line_no").alias("start_line"), F.col("col").alias("start_col"),
        F.lit(None).cast("string").alias("scope_id"), "is_definition")
