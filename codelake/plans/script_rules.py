"""JavaScript and TypeScript extraction over tokens and top-level statements."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions.text import row_id
from codelake.plans.lines import KEY, PAST, TOKEN_ORDER, by_file, module_scopes, raw_slice, tokens
from codelake.plans.nesting import nest

# Words that are never references.
KEYWORDS = ["abstract", "await", "break", "case", "catch", "class", "const", "continue",
            "debugger", "declare", "default", "delete", "do", "else", "enum", "export", "extends",
            "false", "finally", "for", "function", "if", "implements", "import", "in",
            "instanceof", "interface", "let", "new", "null", "private", "protected", "public",
            "readonly", "return", "static", "super", "switch", "this", "throw", "true", "try",
            "typeof", "undefined", "var", "void", "while", "with", "yield"]
_MODIFIERS = ["static", "async", "get", "set", "*", "public", "private", "protected", "readonly",
              "override", "accessor"]
_COUNTED = ["static", "async"]
_DECLARE = ["const", "let", "var"]
_CONDITIONS = ["if", "while", "for", "switch", "catch", "with"]
# Tokens after which a statement goes on, and with which a line continues the one before.
_RUNS_ON = ["=", "(", "[", "{", ",", ".", "?.", ":", "?", "&&", "||", "??", "+", "-", "*", "/",
            "%", "=>", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "|", "&", "^", "+=", "-=",
            "return", "extends", "implements", "new", "typeof", "in", "of", "from", "import"]
_HANGS_ON = [".", "?.", "?", ":", "&&", "||", "??", "+", "-", "*", "/", "%", "=", "==", "===",
             "!=", "!==", "<", ">", "<=", ">=", "|", "&", ")", "]", ",", "=>", "in", "of"]
_BEFORE_OBJECT = ["=", "(", ",", ":", "[", "return", "?", "&&", "||", "??", "...", "default",
                  "const", "let", "var"]
_IDENT = r"^[\p{L}_$]"


def _same(rows: DataFrame) -> DataFrame:
    """In place of what gives rows the keys of their files, where these are not numbered."""
    return rows


def coded(token: Column) -> Column:
    """A token as a number, so that the rows of the windows hold the text of their own token only: 62 bits of its
    hash, and in the lowest two whether it is a name or word (1), a text literal (2) or anything else (0)."""
    kind = F.when(token.rlike(_IDENT), 1).when(token.startswith('"'), 2).otherwise(0).cast("bigint")
    return F.xxhash64(token).bitwiseAND(F.lit(-4).cast("bigint")).bitwiseOR(kind)


def _word(text: str) -> str:
    """The SQL of coded() for a fixed word."""
    return f"((xxhash64('{text}') & -4L) | {1 if text[0].isalpha() or text[0] in '_$' else 0}L)"


def _is(column: str | Column, *words: str) -> Column:
    """True when the coded token is one of the words; NULL counts as no."""
    if isinstance(column, str):
        listed = ", ".join(_word(w) for w in words)
        return F.expr(f"coalesce({column} IN ({listed}), false)")
    return F.coalesce(reduce(lambda a, b: a | b, [column == F.expr(_word(w)) for w in words]), F.lit(False))


def _named(code: str) -> Column:
    """Whether a coded token is a name or word; NULL counts as no."""
    return F.coalesce(F.col(code).bitwiseAND(F.lit(3).cast("bigint")) == 1, F.lit(False))


def neighbours(line_rows: DataFrame) -> DataFrame:
    """Tokens as (position, end, text, code) with the codes of those around them; after `function` and `class` also
    the text of the next one.

    A position is the line number in the upper and the column in the lower 32 bits, so it orders
    the tokens and says where they are; rows stay slim through the sorts that follow.
    """
    w = by_file(*TOKEN_ORDER)
    upto = w.rowsBetween(PAST, 0)
    # All that needs no position is found with the places of the tokens, all that looks at it in a second pass.
    t = tokens(line_rows, {"code": coded(F.col("tok"))}, {
        **{f"t{i}": F.lag("code", i).over(w) for i in (1, 2, 3)},
        "next": F.lead("code").over(w), "next_tok": F.lead("tok").over(w), "_before": F.lag("line_no").over(w),
        **{f"_{m}": F.count_if(_is("code", m)).over(upto) for m in _COUNTED}})
    high = F.shiftleft(F.col("line_no").cast("bigint"), 32)
    new_line = F.coalesce(F.col("_before") != F.col("line_no"), F.lit(True))
    breaks = new_line & ~_is("t1", *_RUNS_ON) & ~_is("code", *_HANGS_ON)
    shown = F.when(_is("code", "function", "class"), F.col("next_tok"))
    t = t.select(*KEY, (F.col("language") == "typescript").alias("typed"), *TOKEN_ORDER, "tok", "code", "delta", "level",
                 (high + F.col("col")).alias("pos"), (high + F.col("end_col")).alias("fin"), "t1", "t2", "t3", "next",
                 shown.alias("next_tok"), *[f"_{m}" for m in _COUNTED], breaks.alias("breaks"))
    # The modifiers right before a token: where their run starts, and which of two are among them. A run may start
    # after any token that is none.
    own = {m: F.col(f"_{m}") - F.when(_is("code", m), 1).otherwise(0) for m in _COUNTED}
    starts = F.when(F.col("t1").isNotNull() & ~_is("t1", *_MODIFIERS), F.struct(
        "pos", *[n.alias(f"_{m}") for m, n in own.items()]))
    lead = F.when(F.col("breaks") & (F.col("level") == 0), F.when(
        _is("code", "export", "declare"), F.col("next")).otherwise(F.col("code")))
    t = t.select("*", F.lead("pos").over(w).alias("next_pos"), F.lag("fin").over(w).alias("ended"),
                 *[F.lag("pos", i).over(w).alias(f"q{i}") for i in (1, 2, 3)],
                 F.max("fin").over(w.rowsBetween(PAST, Window.unboundedFollowing)).alias("eof"),
                 F.last(starts, True).over(upto).alias("_start"), F.last(lead, True).over(upto).alias("_lead"))
    return t.withColumns({
        "modified": F.struct(
            F.coalesce("_start.pos", "pos").alias("pos"),
            *[(n > F.coalesce(F.col(f"_start._{m}"), F.lit(0))).alias(m) for m, n in own.items()]),
        "in_type": _is("_lead", "type", "interface"),
    }).drop("_start", "_lead", *[f"_{m}" for m in _COUNTED], *TOKEN_ORDER)


def line_of(position: str | Column) -> Column:
    col = F.col(position) if isinstance(position, str) else position
    return F.shiftright(col, 32).cast("int")


def column_of(position: str | Column) -> Column:
    col = F.col(position) if isinstance(position, str) else position
    return col.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _level():
    return Window.partitionBy(*KEY, "level").orderBy("pos")


def _past(value: Column) -> Column:
    """The last value at this bracket level before the token."""
    return F.last(value, True).over(_level().rowsBetween(PAST, -1))


def _ahead(column: str) -> Column:
    """The next value at this bracket level; in the same order, so it needs no sort of its own."""
    return F.expr(f"lead({column}) IGNORE NULLS").over(_level())


def _with_role(rows: DataFrame, *more: Column) -> DataFrame:
    """What each opening bracket opens; `more` are the caller's level windows, worked out in the same pass."""
    header = _past(F.when(_is("code", "class", "interface", "function", "enum", "{", "}", ";")
                          & ~_is("t1", "."), F.col("code")))
    rows = rows.withColumn("_closed", F.when(F.col("delta") == -1, F.struct("fin", "next")))
    return rows.select("*", header.alias("header"), _ahead("_closed").alias("closer"), *more).drop("_closed")


def _with_around(rows: DataFrame) -> DataFrame:
    """For every token, what kind of bracket it stands in."""
    names = (_is("t1", "import", "export") | (_is("t1", "type") & _is("t2", "import", "export"))
             | (_is("t1", ",") & _is("t3", "import")))
    role = (F.when(~_is("code", "{"), F.col("code"))
            .when(_is("header", "class", "interface"), F.col("header"))
            .when(names, F.expr(_word("names"))).when(_is("t1", *_BEFORE_OBJECT), F.expr(_word("object")))
            .otherwise(F.expr(_word("block"))))
    opened = F.when(F.col("delta") == 1, F.struct(
        role.alias("role"), F.col("t1").alias("before"), F.col("closer.next").alias("after")))
    rows = rows.withColumn("_opened", opened).withColumn("_in", F.col("level") + F.when(
        F.col("delta") == 1, 1).otherwise(0))
    inside = Window.partitionBy(*KEY, "_in").orderBy("pos").rowsBetween(PAST, -1)
    return rows.withColumn("around", F.last("_opened", True).over(inside)).drop("_opened", "_in")


def spans(rows: DataFrame) -> DataFrame:
    """Functions, arrow functions, classes and methods with exact first and last positions.

    Only tokens that shape the structure are kept before the windows by bracket level.
    """
    word = _named("code")
    shape = ((F.col("delta") != 0) | F.col("breaks") | (word & _is("next", "("))
             | _is("t1", *_DECLARE) | _is("code", "=>", ";", ",", "function", "class", "interface",
                                          "enum"))
    t = _with_role(
        rows.where(shape),
        _past(F.when(F.col("delta") == 1, F.struct("pos", "t1", "q1", "t2", "q2"))).alias("opener"),
        _past(F.when(_is("t1", *_DECLARE) & word, F.struct("tok", "pos", "next", "next_pos"))).alias("decl"))
    t = t.withColumn("_body", F.when(_is("code", "{", ";"), F.struct("code", F.col("closer.fin").alias("fin"))))
    # The nearest body brace or statement end at the token's level, and where that body closes.
    t = _with_around(t.select("*", _ahead("_body").alias("body")).drop("_body"))
    # Brackets that open nothing of a rule have done their work; what ends an expression is still needed.
    stops = _is("code", ";", ",") | (F.col("delta") == -1) | F.col("breaks")
    begins = _is("code", "function", "class", "=>") | (word & _is("next", "("))
    t = t.where(stops | begins).withColumns({
        "_of": F.col("level") + F.when(F.col("delta") == -1, 1).otherwise(0),
        "_stop": F.when(stops, F.col("ended"))})
    t = t.withColumn("stop", F.expr("lead(_stop) IGNORE NULLS").over(
        Window.partitionBy(*KEY, "_of").orderBy("pos"))).where(begins)

    text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    yes, no = F.lit(True), F.lit(False)
    has_body = _is("body.code", "{")

    def row(kind, shown, name, begin, end, symbol, static, asyn, bound_at, scoped=yes):
        return F.struct(
            F.lit(kind).alias("kind"), shown.alias("scope_name"), name.alias("name"),
            begin.alias("begin"), end.alias("fin"), symbol.alias("is_symbol"),
            static.alias("is_static"), asyn.alias("is_async"), bound_at.alias("bound_at"),
            scoped.alias("is_scope"))

    def bound(sign: Column, at: Column) -> Column:
        """The declared variable this function value belongs to, by its position."""
        fits = (F.col("decl.next_pos") == at) | _is("decl.next", ":")
        return F.when(_is(sign, "=") & fits, F.col("decl.pos"))

    is_async = _is("t1", "async")
    sign = F.when(is_async, F.col("t2")).otherwise(F.col("t1"))
    expression = _is(sign, "=", "(", "[", ",", ":", "?", "=>", "return", "&&", "||", "??", "new",
                     "!", "+")
    fn_at = bound(sign, F.when(is_async, F.col("q2")).otherwise(F.col("q1")))
    named = _named("next")
    function = F.when(_is("code", "function") & ~_is("t1", ".") & has_body, row(
        "function", F.when(~expression & named, F.col("next_tok")),
        F.when(expression, F.col("decl.tok")).otherwise(F.col("next_tok")),
        F.when(is_async, F.col("q1")).otherwise(F.col("pos")), F.col("body.fin"),
        F.when(expression, fn_at.isNotNull()).otherwise(named), no, is_async,
        F.when(expression, fn_at)))
    class_ = F.when(
        _is("code", "class") & named & has_body
        & ~_is("t1", ".", "=", "(", ",", "return", ":", "abstract"),
        row("class", F.col("next_tok"), F.col("next_tok"), F.col("pos"), F.col("body.fin"), yes, no, no,
            number))
    method = F.when(
        word & ~_is("code", "function", *_CONDITIONS) & _is("next", "(") & has_body
        & _is("around.role", "class") & _is("closer.next", "{", ":")
        & ~_is("t1", "=", "new", ".", "=>"),
        row("method", text, F.col("tok"),
            F.col("modified.pos"), F.col("body.fin"), yes, F.col("modified.static"),
            F.col("modified.async"), number, no))
    # An arrow function starts at its single parameter or at the bracket of its parameters.
    single = _named("t1") & ~_is("t2", ":", ".", "|", "&")
    names = [F.when(single, F.col(f"t{i + 1}")).otherwise(F.col(f"opener.t{i}")) for i in (1, 2)]
    at = [F.when(single, F.col("q1")).otherwise(F.col("opener.pos"))] + [
        F.when(single, F.col(f"q{i + 1}")).otherwise(F.col(f"opener.q{i}")) for i in (1, 2)]
    a_async = _is(names[0], "async")
    a_bound = bound(F.when(a_async, names[1]).otherwise(names[0]),
                    F.when(a_async, at[2]).otherwise(at[1]))
    a_end = F.when(_is("next", "{"), F.col("body.fin")).otherwise(F.coalesce("stop", "eof"))
    arrow = F.when(_is("code", "=>") & ~F.col("in_type") & at[0].isNotNull(), row(
        "function", text, F.col("decl.tok"), F.when(a_async, at[1]).otherwise(at[0]),
        a_end, a_bound.isNotNull(), no, a_async, a_bound))
    # Exploding keeps the four rules from being evaluated once per output column.
    found = F.filter(F.array(method, function, class_, arrow), lambda f: f["fin"].isNotNull())
    return t.select(*KEY, F.explode(found).alias("f")).select(*KEY, "f.*")


def symbols(found: DataFrame, keyed: Callable[[DataFrame], DataFrame] = _same) -> DataFrame:
    """Functions, function values bound to a variable, classes and methods, from spans()."""
    first = F.coalesce("bound_at", "begin")
    s = found.where("is_symbol").select(
        *KEY, "name", "kind", "is_static", "is_async", first.alias("begin"), "fin",
        F.col("bound_at").isNotNull().alias("_bound"))
    n = keyed(nest(s, "begin", "fin", ["name", "begin"]))
    parent = F.try_element_at("chain", F.lit(-1))
    hidden = F.col("_bound") & F.col("name").startswith("_")
    text = F.lit(None).cast("string")
    return n.select(
        row_id(*KEY, "name", line_of("begin")).alias("symbol_id"), *KEY, "name",
        F.array_join(F.concat("chain.name", F.array("name")), ".").alias("qualified_name"),
        "kind", F.when(hidden, "private").otherwise("public").alias("visibility"),
        line_of("begin").alias("start_line"), line_of("fin").alias("end_line"),
        column_of("begin").alias("start_col"), column_of("fin").alias("end_col"),
        F.when(parent.isNotNull(), row_id(*KEY, parent["name"], line_of(parent["begin"])))
        .alias("parent_symbol_id"), text.alias("scope_id"), text.alias("docstring"),
        text.alias("signature"), "is_async", "is_static",
        F.array().cast("array<string>").alias("decorators"), F.lit("{}").alias("metadata"))


def scopes(found: DataFrame, files: DataFrame, keyed: Callable[[DataFrame], DataFrame] = _same) -> DataFrame:
    """The module of each file, and its functions, arrow functions and classes."""
    s = found.where("is_scope").select(*KEY, "kind", F.col("scope_name").alias("name"),
                                             "begin", "fin")
    n = keyed(nest(s, "begin", "fin", ["begin"]))
    parent = F.try_element_at("chain", F.lit(-1))
    module_id = row_id(*KEY, F.lit("module"))
    inner = n.select(
        row_id(*KEY, F.lit("scope"), "begin").alias("scope_id"), *KEY,
        F.when(parent.isNotNull(), row_id(*KEY, F.lit("scope"), parent["begin"]))
        .otherwise(module_id).alias("parent_scope_id"), "kind", "name",
        line_of("begin").alias("start_line"), line_of("fin").alias("end_line"), "depth")
    return module_scopes(files).unionByName(inner)


def references(rows: DataFrame, keyed: Callable[[DataFrame], DataFrame] = _same) -> DataFrame:
    """Identifier tokens: call, write or read; property names and type names are none."""
    t = _with_around(_with_role(rows))
    ts = F.col("typed")
    ident_before = _named("t1") | _is("t1", ")", "]", "}")
    text_next = F.coalesce(F.col("next").bitwiseAND(F.lit(3).cast("bigint")) == 2, F.lit(False))
    soft = ((_is("code", "from") & text_next)
            | (_is("code", "as") & (ident_before | _is("t1", "*")))
            | (_is("code", "of") & ident_before)
            | (_is("code", "async") & (_is("next", "function", "(") | _named("next")))
            | (_is("code", "type") & _is("t1", "import", "export") & _is("next", "{")))
    member = _is("around.role", "class") & (
        _is("t1", "{", "}", ";", "#", *_MODIFIERS) | _is("code", *_MODIFIERS) | F.col("breaks"))
    key = _is("around.role", "object") & _is("t1", "{", ",") & _is("next", ":", ",", "}", "=", "(")
    annotation = ts & _is("t1", ":") & (
        _is("t2", ")", "?", "!") | _is("t3", *_DECLARE) | _is("around.role", "class", "interface")
        | (_is("around.role", "(") & _is("t3", "(", ",", *_MODIFIERS)))
    type_name = ts & (_is("t1", "class", "implements", "enum") | annotation
                      | (_is("t1", "as") & ~_is("around.role", "names"))
                      | (_is("t1", "<") & _is("next", ">", ",")))
    wanted = (_named("code") & ~_is("code", *KEYWORDS) & ~_is("t1", ".", "?.")
              & ~soft & ~F.col("in_type") & ~member & ~key & ~type_name)
    params = _is("around.role", "(") & _is("around.after", "{", "=>", ":") & ~_is(
        "around.before", *_CONDITIONS)
    write = ((_is("t1", *_DECLARE) & ~_is("next", "of", "in")) | (_is("next", "=") & ~params))
    call = (_is("next", "(") | text_next) & ~_is("t1", "function", "new", "*")
    kind = F.when(write, "write").when(call, "call").otherwise("read")
    found = keyed(t.where(wanted).select(
        *KEY, "tok", "pos", kind.alias("kind"), _is("t1", "function", "class").alias("is_definition")))
    return found.select(
        row_id(*KEY, "tok", "pos").alias("reference_id"), *KEY,
        F.lit(None).cast("string").alias("symbol_id"), F.col("tok").alias("name"), "kind",
        line_of("pos").alias("start_line"), column_of("pos").alias("start_col"),
        F.lit(None).cast("string").alias("scope_id"), "is_definition")


def types(statements: DataFrame) -> DataFrame:
    """`type X = expr` and `interface X` of TypeScript files."""
    name = r"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:type|interface)\s+([\w$]+)"
    lead = r"^\s*(?:export\s+)?(?:declare\s+)?type\s+[\w$]+\s*(?:<[^=]*>)?\s*=\s*"
    at = F.length(F.regexp_extract("code", lead, 0))
    body = F.length(F.regexp_replace("code", r"[\s;]+$", ""))
    expression = F.when(F.col("kind") == "alias", raw_slice(at, body - at)).otherwise("interface")
    return (statements.where("kind in ('alias', 'interface') and language = 'typescript'").select(
        row_id(*KEY, "kind", "line_no").alias("type_id"), *KEY,
        F.lit(None).cast("string").alias("symbol_id"),
        F.regexp_extract("code", name, 1).alias("name"), "kind",
        expression.alias("type_expression"), F.col("line_no").alias("start_line"),
        F.col("last_line").alias("end_line"), F.lit(False).alias("is_generic"),
        F.array().cast("array<string>").alias("generic_params"),
        F.lit("{}").alias("metadata")))


def imports(statements: DataFrame, line_rows: DataFrame) -> DataFrame:
    """`import ... from 'm'` with the names in braces, and `require('m')` calls."""
    kept = F.left("raw", F.length(F.regexp_replace("code", r"\s+$", "")))
    module = F.regexp_extract(kept, r"(?s)(?:\bfrom\s*|^\s*import\s*)[\"']([^\"']*)[\"']", 1)
    braces = F.regexp_extract("code", r"(?s)^\s*import\b[^{\"]*\{([^}]*)\}", 1)
    names = F.filter(F.transform(F.split(braces, ","), lambda x: F.regexp_extract(
        x, r"^\s*(?:type\s+(?!as\b))?([\w$]+)", 1)), lambda x: x != "")
    plain = statements.where("kind = 'import'").select(
        *KEY, module.alias("module_path"), names.alias("imported_names"),
        F.lit("import").alias("import_kind"), F.col("line_no").alias("start_line"),
        F.lit(0).alias("_i")).where("module_path != ''")
    # A require call: masked code shows the call, the raw text of its line the module.
    calls = F.regexp_count("code", F.lit(r"(?:^|[^\w$.])require\s*\(\s*\"'*"))
    literal = F.regexp_extract_all(
        "line", F.lit(r"(?:^|[^\w$.])require\s*\(\s*[\"'`]([^\"'`]*)[\"'`]"), F.lit(1))
    required = (line_rows.where(calls > 0)
                .select(*KEY, "line_no", F.posexplode(literal).alias("_i", "module_path"))
                .select(*KEY, "module_path",
                        F.array().cast("array<string>").alias("imported_names"),
                        F.lit("require").alias("import_kind"),
                        F.col("line_no").alias("start_line"), "_i"))
    rows = plain.unionByName(required)
    return rows.select(
        row_id(*KEY, "module_path", "start_line", "_i").alias("import_id"), *KEY, "module_path",
        "imported_names", F.lit(None).cast("string").alias("alias"),
        F.lit(False).alias("is_relative"), F.lit(0).alias("relative_level"), "import_kind",
        "start_line", F.lit(False).alias("is_type_only"))


def exports(statements: DataFrame) -> DataFrame:
    """Names in `export { ... }` and `export default`."""
    braces = F.regexp_extract("code", r"(?s)^\s*export\s*(?:type\s*)?\{([^}]*)\}", 1)
    names = F.filter(F.transform(F.split(braces, ","), lambda x: F.regexp_extract(
        x, r"^\s*(?:type\s+(?!as\b))?([\w$]+)", 1)), lambda x: x != "")
    default = F.col("code").rlike(r"^\s*export\s+default\b")
    one = F.array(F.struct(F.lit("default").alias("name"), F.lit("default").alias("kind")))
    many = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("direct").alias("kind")))
    rows = statements.where("kind = 'export'").select(
        *KEY, "line_no", F.explode(F.when(default, one).otherwise(many)).alias("e"))
    return rows.select(
        row_id(*KEY, "e.kind", "e.name", "line_no").alias("export_id"), *KEY,
        F.lit(None).cast("string").alias("symbol_id"), F.col("e.name").alias("exported_name"),
        F.lit(None).cast("string").alias("original_name"), F.col("e.kind").alias("export_kind"),
        F.col("line_no").alias("start_line"))
