"""The expected rows of every registered query as SQL over the given tables.

For the code corpus nothing is parsed: the template fixes what each file defines and where, so
the rows follow from `part` alone. What the templates contain is listed here by hand, line by
line, independently of the extraction rules.
"""

from __future__ import annotations

from codelake import feeds
from codelake.plans import sql_checks

PARTS = """parts AS (
  SELECT CAST(p_partkey AS VARCHAR) AS k,
    CAST(greatest(p_partkey - 3, p_partkey % 3) AS VARCHAR) AS j,
    CAST(p_size AS VARCHAR) AS n, p_brand AS b, p_size % 4 AS s, p_partkey % 3 AS lang,
    p_partkey AS key, greatest(p_partkey - 3, p_partkey % 3) AS prior,
    'proj-' || CAST(p_partkey // 30 AS VARCHAR) AS project_id,
    'src/m' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.js' ELSE '.ts' END
      AS file_path FROM part)"""
_TEMPLATE = {"py": (0, feeds.PYTHON_LINES), "js": (1, feeds.JAVASCRIPT_LINES),
             "ts": (2, feeds.TYPESCRIPT_LINES)}
END = object()


def _place(lang: str, text, nth: int = 0) -> tuple[int, int]:
    """(line without filler, 1 when the filler comes before) of a template line."""
    rows = _TEMPLATE[lang][1]
    filler = rows.index(feeds.FILLER)
    if text is END:
        at = len(rows) - 1
    else:
        whole = not text.strip(" };)")
        at = [i for i, r in enumerate(rows)
              if (r == text if whole else r.startswith(text))][nth]
    return (at + 1, 0) if at <= filler else (at, 1)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def _fill(column: str) -> str:
    out = f"CAST(v.{column} AS VARCHAR)"
    for mark in "kjnb":
        out = f"replace({out}, '{{{mark}}}', p.{mark})"
    return out


def _truth(lang: str, columns: list[str], rows: list[tuple]) -> str:
    """SELECT of hand-listed rows; a cell that is a pair of ints is a line."""
    if not rows:
        raise ValueError("no rows")
    names, cells, shown = [], [[] for _ in rows], []
    for i, column in enumerate(columns):
        values = [r[i] for r in rows]
        if any(isinstance(v, tuple) for v in values):
            names += [f"a{i}", f"m{i}"]
            for cell, v in zip(cells, values):
                cell += [str(v[0]), str(v[1])]
            shown.append(f"CAST(v.a{i} + v.m{i} * p.s AS BIGINT) AS {column}")
            continue
        names.append(f"a{i}")
        for cell, v in zip(cells, values):
            cell.append(_literal(v))
        known = [v for v in values if v is not None]
        if known and isinstance(known[0], bool):
            shown.append(f"CAST(v.a{i} AS BOOLEAN) AS {column}")
        elif known and isinstance(known[0], int):
            shown.append(f"CAST(v.a{i} AS BIGINT) AS {column}")
        else:
            shown.append(f"{_fill(f'a{i}')} AS {column}")
    values = ",\n".join("(" + ", ".join(c) + ")" for c in cells)
    return (f"SELECT p.project_id, p.file_path, {', '.join(shown)} FROM parts p, (VALUES {values}) "
            f"v({', '.join(names)}) WHERE p.lang = {_TEMPLATE[lang][0]}")


def _with(**ctes: str) -> str:
    return "WITH " + PARTS + "".join(f",\n{n} AS ({q})" for n, q in ctes.items())


def _py(text, nth=0):
    return _place("py", text, nth)


def _js(text, nth=0):
    return _place("js", text, nth)


def _ts(text, nth=0):
    return _place("ts", text, nth)


SYMBOL = ["name", "qualified_name", "kind", "visibility", "start_line", "end_line", "start_col",
          "end_col", "signature", "docstring", "is_async", "is_static", "decorators"]
PY_SYMBOLS = [
    ("Part{k}", "Part{k}", "class", "public", _py("class Part"), _py("    def __hide"), 0, 33,
     "class Part{k}(Base)", "A part of {b}.", False, False, '@register("{b}")'),
    ("Inner{k}", "Part{k}.Inner{k}", "class", "public", _py("    class Inner"),
     _py("            return 1"), 4, 20, "class Inner{k}", None, False, False, ""),
    ("deep", "Part{k}.Inner{k}.deep", "method", "public", _py("        def deep"),
     _py("            return 1"), 8, 20, "deep(self)", None, False, False, ""),
    ("size", "Part{k}.size", "method", "public", _py("    def size"),
     _py("        return total"), 4, 20, "size(self) -> int", "Size # not a comment.", False,
     False, "@property|@cached(1)"),
    ("_load", "Part{k}._load", "method", "protected", _py("    async def _load"),
     _py("        return helper"), 4, 27,
     "_load(\n        self,\n        path: str,\n        limit: int = 10,\n    ) -> Part{j}",
     None, True, False, ""),
    ("__hide", "Part{k}.__hide", "method", "private", _py("    def __hide"),
     _py("    def __hide"), 4, 33, "__hide(self)", None, False, False, ""),
    ("size_{k}", "size_{k}", "function", "public", _py("def size_"), _py("    return inner"), 0,
     23, 'size_{k}(value: int, *args, flag: bool = False) -> "Part{k}"', None, False, False, ""),
    ("inner", "size_{k}.inner", "function", "public", _py("    def inner"),
     _py("        return x"), 4, 16, "inner(x)", None, False, False, ""),
]


def _script_symbol(name, qualified, kind, visibility, start, end, col, end_col, asyn=False,
                   static=False):
    return (name, qualified, kind, visibility, start, end, col, end_col, None, None, asyn, static,
            "")


JS_SYMBOLS = [
    _script_symbol("Part{k}", "Part{k}", "class", "public", _js("export class"), _js("}", 0), 7,
                   1),
    _script_symbol("constructor", "Part{k}.constructor", "method", "public", _js("  constructor"),
                   _js("  }", 0), 2, 3),
    _script_symbol("load", "Part{k}.load", "method", "public", _js("  static async load"),
                   _js("  }", 1), 2, 3, True, True),
    _script_symbol("label", "Part{k}.label", "method", "public", _js("  get label"),
                   _js("  get label"), 2, 37),
    _script_symbol("size{k}", "size{k}", "function", "public", _js("function size"), _js("}", 1),
                   0, 1),
    _script_symbol("inner", "size{k}.inner", "function", "public", _js("  const inner"),
                   _js("  const inner"), 8, 28),
    _script_symbol("_hidden", "size{k}._hidden", "function", "private", _js("  const _hidden"),
                   _js("  };"), 8, 3, True),
    _script_symbol("main{k}", "main{k}", "function", "public", _js("export async function"),
                   _js("}", 2), 7, 1, True),
]
TS_SYMBOLS = [
    _script_symbol("Store{k}", "Store{k}", "class", "public", _ts("class Store"), _ts("}", 1), 0,
                   1),
    _script_symbol("make", "Store{k}.make", "method", "public", _ts("  static make"),
                   _ts("  }"), 2, 3, False, True),
    _script_symbol("build{k}", "build{k}", "function", "public", _ts("export const build"),
                   _ts("};"), 13, 1, True),
]
TYPE = ["name", "kind", "type_expression", "start_line", "end_line"]


def _note(expression, line):
    return ("", "annotation", expression, line, line)


PY_TYPES = [
    ("Alias{k}", "alias", "dict", _py("Alias"), _py("Alias")),
    ("LIMIT", "alias", "{n}", _py("LIMIT"), _py("LIMIT")),
    _note("int", _py("LIMIT")), _note("str", _py("    kind")), _note("int", _py("    def size")),
    _note("str", _py("        path:")), _note("int", _py("        limit:")),
    _note("Part{j}", _py("    ) -> ")), _note("int", _py("def size_")),
    _note("bool", _py("def size_")), _note('"Part{k}"', _py("def size_")),
]
TS_TYPES = [
    ("Key{k}", "alias", "string | number", _ts("export type"), _ts("export type")),
    ("Mode", "alias", "'a'\n  | 'b'", _ts("type Mode"), _ts("  | 'b'")),
    ("Shape{k}", "interface", "interface", _ts("export interface"), _ts("}", 0)),
]
IMPORT = ["module_path", "imported_names", "alias", "is_relative", "relative_level",
          "import_kind", "start_line"]
PY_IMPORTS = [
    ("os", "", None, False, 0, "import", _py("import os")),
    ("json", "", "js", False, 0, "import", _py("import json")),
    ("sys", "", None, False, 0, "import", _py("import json")),
    ("collections", "OrderedDict|defaultdict", None, False, 0, "from_import", _py("from coll")),
    (".m{j}", "size_{j}|Part{j}", None, True, 1, "from_import", _py("from .m")),
    (".", "", None, True, 1, "from_import", _py("from . ")),
]
JS_IMPORTS = [
    ("./m{j}", "size{j}|Part{j}", None, False, 0, "import", _js("import { size")),
    ("fs", "", None, False, 0, "import", _js("import fs")),
    ("path", "join|resolve", None, False, 0, "import", _js("import {", 1)),
    ("lib{j}", "", None, False, 0, "require", _js("const lib")),
]
TS_IMPORTS = [
    ("./m{j}", "Shape{j}", None, False, 0, "import", _ts("import type")),
    ("reflect", "", None, False, 0, "import", _ts("import 'reflect'")),
]
EXPORT = ["exported_name", "export_kind", "start_line"]
PY_EXPORTS = [("Part{k}", "direct", _py('    "Part')), ("size_{k}", "direct", _py("    'size_"))]
JS_EXPORTS = [("size{k}", "direct", _js("export {")), ("lib", "direct", _js("export {")),
              ("default", "default", _js("export default"))]
TS_EXPORTS = [("Store{k}", "direct", _ts("export {"))]
SCOPE = ["kind", "name", "start_line", "end_line", "depth"]


def _scope_kind(kind):
    return "class" if kind == "class" else "function"


PY_SCOPES = [("module", None, (1, 0), _py(END), 0)] + [
    (_scope_kind(s[2]), s[0], s[4], s[5], s[1].count(".") + 1) for s in PY_SYMBOLS]
JS_SCOPES = [
    ("module", None, (1, 0), _js(END), 0),
    ("class", "Part{k}", _js("export class"), _js("}", 0), 1),
    ("function", "size{k}", _js("function size"), _js("}", 1), 1),
    ("function", None, _js("  const inner"), _js("  const inner"), 2),
    ("function", None, _js("  const _hidden"), _js("  };"), 2),
    ("function", None, _js("  return rest"), _js("  });"), 2),
    ("function", "main{k}", _js("export async function"), _js("}", 2), 1),
]
TS_SCOPES = [
    ("module", None, (1, 0), _ts(END), 0),
    ("class", "Store{k}", _ts("class Store"), _ts("}", 1), 1),
    ("function", None, _ts("export const build"), _ts("};"), 1),
]
# Identifiers of each template line in order; reads unless marked call, write or def.
REFERENCES = {
    "py": [
        ("import os", "os"), ("import json", "json js sys"), ("from collections", "collections"),
        ("    OrderedDict", "OrderedDict"), ("    defaultdict", "defaultdict dd"),
        ("from .m", "m{j} size_{j} Part{j}"), ("__all__", "__all__:write"),
        ("Alias", "Alias{k}:write dict"), ("LIMIT", "LIMIT:write int"),
        ("@register", "register:call"),
        ("class Part", "Part{k}:def Base other Other metaclass Meta"),
        ("    kind", "kind:write str"), ("    class Inner", "Inner{k}:def"),
        ("        def deep", "deep:def self"), ("    @property", "property"),
        ("    @cached", "cached:call"), ("    def size", "size:def self int"),
        ("        total = {n}", "total:write"), (feeds.FILLER, "total:write total"),
        ("        return total", "total"), ("    async def", "_load:def"),
        ("        self,", "self"), ("        path:", "path str"), ("        limit:", "limit int"),
        ("    ) -> ", "Part{j}"), ("        text", "text:write path limit"),
        ("        return helper", "helper:call text"), ("    def __hide", "__hide:def self"),
        ("def size_", "size_{k}:def value int args flag bool"), ("    def inner", "inner:def x"),
        ("        return x", "x"), ("    total = size", "total:write size_{j}:call value"),
        ("    return inner", "inner:call total"),
    ],
    "js": [
        ("import { size", "size{j} Part{j} Other"), ("import fs", "fs"), ("  join", "join"),
        ("  resolve", "resolve"), ("const lib", "lib:write require:call"),
        ("export class", "Part{k}:def Other"), ("  constructor", "name"), ("    super", "name"),
        ("    this", "name@24"), ("  static async", "path"), ("    let total", "total:write"),
        (feeds.FILLER, "total:write total"), ("    if (", "total"),
        ("      total", "total:write size{j}:call total"), ("    return total", "total"),
        ("function size", "size{k}:def value rest"), ("  const inner", "inner:write x x"),
        ("  const _hidden", "_hidden:write y"), ("    return inner", "inner:call y"),
        ("  return rest", "rest item"), ("    return _hidden", "_hidden:call item"),
        ("export async", "main{k}:def"), ("  return size", "size{k}:call fs join"),
        ("export {", "size{k} lib library"), ("export default", "Part{k}"),
    ],
    "ts": [
        ("import type", "Shape{j}"), ("  static make", "n"), ("    return new", "Store{k}"),
        ("export const", "build{k}:write key"), ("  const s", "s:write Store{k}"),
        ("  return wrap", "wrap:call s key"), ("export {", "Store{k} Store"),
    ],
}
_FILLERS = {"py": feeds.PYTHON_FILLER, "js": feeds.JAVASCRIPT_FILLER, "ts": ""}


def _reference_rows(lang: str) -> str:
    rows = []
    lines = _TEMPLATE[lang][1]
    for start, names in REFERENCES[lang]:
        repeat = int(start == feeds.FILLER)
        text = _FILLERS[lang] if repeat else next(r for r in lines if r.startswith(start))
        line = _place(lang, start)
        at = 0
        for item in names.split():
            name, _, kind = item.partition(":")
            name, _, fixed = name.partition("@")
            at = int(fixed) if fixed else _find(text, name, at)
            prefix = text[:at]
            marks = [prefix.count("{%s}" % m) for m in "kjnb"]
            rows.append((name, "read" if kind in ("", "def") else kind, line, at, *marks,
                         kind == "def", repeat))
            at += len(name)
    values = ",\n".join("(" + ", ".join(
        [_literal(r[0]), _literal(r[1]), str(r[2][0]), str(r[2][1]), *map(str, r[3:8]),
         _literal(r[8]), str(r[9])]) + ")" for r in rows)
    width = " + ".join(f"v.{m} * (length(p.{m[1]}) - 3)" for m in ("ck", "cj", "cn", "cb"))
    return f"""SELECT p.project_id, p.file_path, {_fill('name')} AS name, v.kind,
      CAST(v.line + v.moved * p.s + v.again * r.i AS BIGINT) AS start_line,
      CAST(v.col + {width} AS BIGINT) AS start_col, v.is_definition
      FROM parts p, (VALUES {values})
      v(name, kind, line, moved, col, ck, cj, cn, cb, is_definition, again),
      (VALUES (0), (1), (2)) r(i)
      WHERE p.lang = {_TEMPLATE[lang][0]} AND r.i < CASE WHEN v.again = 1 THEN p.s ELSE 1 END"""


def _find(text: str, name: str, at: int) -> int:
    """Place of a whole word."""
    while True:
        at = text.index(name, at)
        before, after = text[at - 1:at], text[at + len(name):at + len(name) + 1]
        if not (before.isalnum() or before == "_") and not (after.isalnum() or after == "_"):
            return at
        at += 1


SYMBOLS = {lang: _truth(lang, SYMBOL, rows) for lang, rows in
           (("py", PY_SYMBOLS), ("js", JS_SYMBOLS), ("ts", TS_SYMBOLS))}
TYPES = {"py": _truth("py", TYPE, PY_TYPES), "ts": _truth("ts", TYPE, TS_TYPES)}
IMPORTS = {lang: _truth(lang, IMPORT, rows) for lang, rows in
           (("py", PY_IMPORTS), ("js", JS_IMPORTS), ("ts", TS_IMPORTS))}
EXPORTS = {lang: _truth(lang, EXPORT, rows) for lang, rows in
           (("py", PY_EXPORTS), ("js", JS_EXPORTS), ("ts", TS_EXPORTS))}
SCOPES = {lang: _truth(lang, SCOPE, rows) for lang, rows in
          (("py", PY_SCOPES), ("js", JS_SCOPES), ("ts", TS_SCOPES))}
REFS = {lang: _reference_rows(lang) for lang in ("py", "js", "ts")}


def _all(kind: dict[str, str], *langs: str) -> str:
    return " UNION ALL ".join(f"({kind[lang]})" for lang in (langs or kind))


_SYMBOL_LIST = "file_path, " + ", ".join(SYMBOL)
_IMPORT_LIST = "file_path, " + ", ".join(IMPORT)
_REF_LIST = "file_path, name, kind, start_line, start_col, is_definition"
_FOUND = ("name, kind, file_path, start_line, end_line, visibility, signature, docstring, "
          "qualified_name")

DOCUMENTS = r"""files AS (
  SELECT doc_id, source AS project_id, source || '/' || lang || '/' || CASE doc_id % 10
      WHEN 0 THEN 'README_' || doc_id || '.md' WHEN 1 THEN 'CHANGELOG-' || doc_id || '.md'
      WHEN 2 THEN 'docs/' || doc_id || '.rst' WHEN 3 THEN 'api-' || doc_id || '.md'
      WHEN 4 THEN 'user-guide_' || doc_id || '.txt'
      WHEN 5 THEN 'CONTRIBUTING-' || doc_id || '.md' WHEN 6 THEN 'LICENSE-' || doc_id
      WHEN 7 THEN 'docs/deep/note_' || doc_id || '.html'
      WHEN 8 THEN 'src/tool_' || doc_id || '.py' ELSE 'notes/' || doc_id || '.markdown' END
      AS file_path,
    CASE doc_id % 4 WHEN 0 THEN '# Heading ' || doc_id || chr(10)
      WHEN 1 THEN 'Title ' || doc_id || chr(10) || '=======' || chr(10) ELSE '' END || text
      AS content FROM documents),
docs AS (
  SELECT project_id, file_path, doc_id, content, CASE doc_id % 10 WHEN 0 THEN 'readme'
      WHEN 1 THEN 'changelog' WHEN 2 THEN 'documentation' WHEN 3 THEN 'api' WHEN 4 THEN 'guide'
      WHEN 5 THEN 'contributing' WHEN 6 THEN 'license' ELSE 'general' END AS doc_type,
    CASE doc_id % 4 WHEN 0 THEN 'Heading ' || doc_id WHEN 1 THEN 'Title ' || doc_id
      ELSE CASE doc_id % 10 WHEN 0 THEN 'Readme ' WHEN 1 THEN 'Changelog ' WHEN 2 THEN ''
        WHEN 3 THEN 'Api ' WHEN 4 THEN 'User Guide ' WHEN 5 THEN 'Contributing '
        WHEN 6 THEN 'License ' WHEN 7 THEN 'Note ' ELSE '' END || doc_id END AS title,
    CASE doc_id % 10 WHEN 2 THEN 'rst' WHEN 4 THEN 'txt' WHEN 6 THEN 'txt' WHEN 7 THEN 'html'
      WHEN 9 THEN 'markdown' ELSE 'md' END AS format,
    CAST(len(regexp_extract_all(content, '\S+')) AS BIGINT) AS word_count,
    sha256(content) AS content_hash FROM files WHERE doc_id % 10 <> 8)"""

MESSAGES = r"""messages AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(conv_id % 5 AS VARCHAR) AS project_id,
    role, text AS content, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS token_count,
    CAST(turn AS BIGINT) AS turn FROM conversations)"""
_ROLLUP = """SELECT project_id, session_id, count(*) AS message_count,
    CAST(sum(token_count) AS BIGINT) AS token_count,
    count(*) FILTER (role = 'user') AS user_messages,
    count(*) FILTER (role = 'assistant') AS assistant_messages,
    count(*) FILTER (role = 'system') AS system_messages FROM messages GROUP BY 1, 2"""
TODOS = """todos AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS todo_id, o_orderkey AS n,
    CAST(o_custkey % 10 AS VARCHAR) AS project_id, 'order ' || o_orderkey AS title,
    o_orderstatus AS status, o_orderpriority AS priority, 'user-' || (o_custkey % 7)
      AS assigned_to, o_orderdate AS created_at FROM orders)"""
_EVENTS = "event_id, user_id, event_type, value, props, CAST(ts AS VARCHAR) AS ts"

RESOLVED = """resolved AS (
  SELECT i.project_id, i.file_path, i.module_path, i.imported_names, i.start_line,
    CASE WHEN i.module_path IN ('.m' || p.j, './m' || p.j) AND p.prior // 30 = p.key // 30
      THEN t.file_path END AS target_file
  FROM imports i JOIN parts p ON i.file_path = p.file_path JOIN parts t ON t.key = p.prior)"""
EDGES = """visible AS (
  SELECT file_path, name, file_path AS target_file, start_line, start_col, kind, 0 AS rank
    FROM symbols
  UNION ALL
  SELECT r.file_path, s.name, s.file_path, s.start_line, s.start_col, s.kind, 1
    FROM resolved r JOIN symbols s ON s.file_path = r.target_file
      AND list_contains(string_split(r.imported_names, '|'), s.name)
      AND s.qualified_name = s.name),
target AS (
  SELECT * FROM visible QUALIFY row_number() OVER (
    PARTITION BY file_path, name ORDER BY rank, target_file, start_line, start_col) = 1),
edges AS (
  SELECT r.file_path AS source_file, r.start_line AS source_line, r.start_col AS source_col,
    t.target_file, t.start_line AS target_line, t.start_col AS target_col,
    CASE WHEN r.kind = 'call' THEN 'call' WHEN t.kind = 'class' THEN 'type_ref'
      ELSE 'definition' END AS edge_type, 'heuristic' AS resolved_by
  FROM refs r JOIN target t ON r.file_path = t.file_path AND r.name = t.name
  WHERE NOT r.is_definition)"""


def _union_counts(pairs: list[tuple[str, str]], label: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS {label}, {q} AS {value}" for n, q in pairs)


_PLACES = "file_path, name, kind, start_line, end_line"


def _code() -> dict[str, str]:
    symbols, imports = _with(symbols=_all(SYMBOLS)), _with(imports=_all(IMPORTS))
    everything = _with(symbols=_all(SYMBOLS), types=_all(TYPES), imports=_all(IMPORTS),
                       exports=_all(EXPORTS), scopes=_all(SCOPES), refs=_all(REFS))
    entities = ["symbols", "types", "imports", "exports", "scopes", "references"]
    table = {e: ("refs" if e == "references" else e) for e in entities}
    counts = [(e, f"(SELECT count(*) FROM {table[e]})") for e in entities]
    height = {lang: _place(lang, END)[0] for lang in _TEMPLATE}
    lines = (f"(CASE lang WHEN 0 THEN {height['py']} WHEN 1 THEN {height['js']} "
             f"ELSE {height['ts']} END + s)")

    def pick(lang, kind, columns):
        return _with(t=_all(kind, *lang.split())) + f" SELECT {columns} FROM t"

    out = {
        "x1_python_symbols": pick("py", SYMBOLS, _SYMBOL_LIST),
        "x2_python_types": pick("py", TYPES, "file_path, " + ", ".join(TYPE)),
        "x3_python_imports": pick("py", IMPORTS, _IMPORT_LIST),
        "x4_python_exports": pick("py", EXPORTS, "file_path, " + ", ".join(EXPORT)),
        "x5_python_scopes": pick("py", SCOPES, "file_path, " + ", ".join(SCOPE)),
        "x6_python_references": pick("py", REFS, _REF_LIST),
        "x7_script_symbols": pick("js ts", SYMBOLS, _SYMBOL_LIST),
        "x8_typescript_types": pick("ts", TYPES, "file_path, " + ", ".join(TYPE)),
        "x9_script_imports": pick("js ts", IMPORTS, _IMPORT_LIST),
        "x10_script_exports": pick("js ts", EXPORTS, "file_path, " + ", ".join(EXPORT)),
        "x11_script_scopes": pick("js ts", SCOPES, "file_path, " + ", ".join(SCOPE)),
        "x11_script_references": pick("js ts", REFS, _REF_LIST),
        "c1_find_symbols": symbols + f""" SELECT {_FOUND} FROM symbols
            WHERE project_id = 'proj-2' AND name LIKE 'size%' AND kind = 'function'
            ORDER BY file_path, start_line, start_col, name LIMIT 100""",
        "c2_file_symbols": symbols + f""" SELECT {_FOUND} FROM symbols
            WHERE project_id = 'proj-1' AND file_path = 'src/m36.py'""",
        "c3_file_imports": imports + f""" SELECT {_IMPORT_LIST} FROM imports
            WHERE project_id = 'proj-1' AND file_path = 'src/m37.js'""",
        "c4_file_exports": _with(exports=_all(EXPORTS)) + """ SELECT file_path, exported_name,
            export_kind, start_line FROM exports
            WHERE project_id = 'proj-1' AND file_path = 'src/m36.py'""",
        "c5_dependencies": imports + """ SELECT file_path, module_path, imported_names,
            import_kind, is_relative, start_line FROM imports WHERE project_id = 'proj-3'""",
        "c6_find_references": _with(refs=_all(REFS)) + f""" SELECT {_REF_LIST} FROM refs
            WHERE project_id = 'proj-2' AND name = 'total'""",
        "c7_index_stats": everything + ",\n" + RESOLVED + ",\n" + EDGES + " "
        + _union_counts([(f"total_{e}", f"CAST({q} AS VARCHAR)") for e, q in counts]
                        + [("total_files", "CAST((SELECT count(*) FROM parts) AS VARCHAR)"),
                           ("total_edges", "CAST((SELECT count(*) FROM edges) AS VARCHAR)")],
                        "metric", "value")
        + """ UNION ALL SELECT 'language_' || CASE lang WHEN 0 THEN 'python'
            WHEN 1 THEN 'javascript' ELSE 'typescript' END, CAST(count(*) AS VARCHAR)
            FROM parts GROUP BY 1""",
        "c8_symbols_across_projects": symbols + """ SELECT 'name-' || substr(project_id, 6)
            AS project_name, name, kind, file_path, start_line FROM symbols WHERE is_async""",
        "c9_project_overview": symbols + """ SELECT 'name-' || substr(p.project_id, 6)
            AS project_name, 'c3' AS git_commit, count(*) AS file_count,
            (SELECT count(*) FROM symbols s WHERE s.project_id = p.project_id) AS symbol_count
            FROM parts p GROUP BY p.project_id""",
        "g1_dependency_edges": imports + """ SELECT file_path, module_path, unnest(CASE
            WHEN imported_names = '' THEN [NULL] ELSE string_split(imported_names, '|') END)
            AS imported_name FROM imports""",
        "g2_resolve_imports": _with(imports=_all(IMPORTS)) + ",\n" + RESOLVED + """
            SELECT file_path, module_path, start_line, target_file FROM resolved""",
        "g3_resolve_references": _with(symbols=_all(SYMBOLS), imports=_all(IMPORTS),
                                       refs=_all(REFS)) + ",\n" + RESOLVED + ",\n" + EDGES + """
            SELECT * FROM edges""",
        "g3_names_through_files": """WITH f AS (SELECT p_partkey AS k, p_partkey // 30 AS project, p_partkey % 30 AS place,
              'm' || p_partkey || '.py' AS file FROM part), users AS (SELECT * FROM f WHERE place > 0)
            SELECT u.file AS source_file, CAST(3 AS BIGINT) AS source_line, CAST(4 AS BIGINT) AS source_col,
              'use_' || u.k AS source_name, r.file AS target_file, CAST(2 AS BIGINT) AS target_line
              FROM users u JOIN f r ON r.project = u.project AND r.place = 0
            UNION ALL SELECT u.file, 4, 4, 'use_' || u.k, o.file, 7
              FROM users u JOIN f o ON o.project = u.project AND o.place = 7
            UNION ALL SELECT u.file, 6, 4, 'use_' || u.k, t.file, CASE t.place WHEN 0 THEN 4 ELSE 9 END
              FROM users u JOIN f t ON t.project = u.project AND t.place IN (0, 7)
              WHERE u.place = 7 AND t.place = 7 OR u.place <> 7 AND (SELECT count(*) FROM f x
                WHERE x.project = u.project AND x.place IN (0, 7)) = 1
            UNION ALL SELECT file, 8, 4, 'only', file, 9 FROM f WHERE place = 7""",
        "g4_assign_scope": _with(refs=_all(REFS), scopes=_all(SCOPES)) + """
            SELECT r.file_path, r.name, r.start_line, r.start_col, s.kind AS scope_kind,
              s.name AS scope_name, s.depth AS scope_depth FROM refs r JOIN scopes s
              ON r.file_path = s.file_path AND r.start_line BETWEEN s.start_line AND s.end_line
            QUALIFY row_number() OVER (PARTITION BY r.file_path, r.start_line, r.start_col
              ORDER BY s.depth DESC, s.start_line DESC) = 1""",
        "g5_qualify_symbols": symbols + """ SELECT file_path, name, start_line, qualified_name,
            CAST(len(string_split(qualified_name, '.')) AS BIGINT) AS depth FROM symbols""",
        "i2_detect_language": "WITH " + PARTS + """ SELECT file_path, CASE lang WHEN 0
            THEN 'python' WHEN 1 THEN 'javascript' ELSE 'typescript' END AS language FROM parts
            UNION ALL SELECT url, CASE WHEN regexp_matches(lower(url), '\\.pyi?$') THEN 'python'
            WHEN regexp_matches(lower(url), '\\.(js|jsx|mjs|cjs)$') THEN 'javascript'
            WHEN regexp_matches(lower(url), '\\.tsx?$') THEN 'typescript' END FROM pages""",
        "i5_index_run_stats": everything + f", indexed AS (SELECT count(*) AS n, count(*) FILTER "
        f"({lines} % 4 <> 0) AS old FROM parts) " + _union_counts(
            [("files_indexed", "(SELECT n - old FROM indexed)"),
             ("files_skipped", "(SELECT old FROM indexed)"), ("files_failed", "0")]
            + [(f"{e}_extracted", q) for e, q in counts], "metric", "value"),
        "i6_replace_files": symbols + f""" SELECT file_path, name, kind, start_line, end_line
            FROM symbols UNION ALL SELECT file_path, 'added', 'function', {height['py']} + s + 1,
            {height['py']} + s + 2 FROM parts WHERE key % 15 = 0""",
        "t3_delete_in_buckets": symbols + f""", gone AS (SELECT *, coalesce(kind = 'class' OR project_id = 'proj-2'
            OR (project_id = 'proj-1' AND file_path = 'src/m36.py'), false) AS hit FROM symbols)
            SELECT {_PLACES}, (SELECT count(*) FROM gone WHERE hit) AS removed FROM gone WHERE NOT hit""",
        # an added function is a symbol and a scope, its name a reference
        "i7_stream_entities": everything + ", counted AS (" + " UNION ALL ".join(
            f"SELECT '{e}' AS table_name, file_path, count(*) AS n FROM {table[e]} GROUP BY file_path"
            for e in entities) + """ UNION ALL SELECT 'files', file_path, 1 FROM parts)
            SELECT table_name, file_path, c.n + CASE WHEN key % 15 = 0 AND table_name IN ('symbols', 'scopes',
              'references') THEN 1 ELSE 0 END AS n FROM counted c JOIN parts p USING (file_path)
            WHERE key % 7 <> 1""",
    }
    out["i6_rewrite_buckets"] = out["i6_replace_files"].replace(
        "FROM symbols UNION", "FROM symbols WHERE project_id IS DISTINCT FROM 'proj-2' UNION") + """
            AND project_id IS DISTINCT FROM 'proj-2'"""
    return out


def _tables() -> dict[str, str]:
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
             "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
    width = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6,
             "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3,
             "benchmark": 2, "labels": 3, "conversations": 4}
    stats = " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS row_count, "
        f"CAST({width[n]} AS BIGINT) AS column_count" for n in names)
    links = """WITH links AS (SELECT page_id, unnest(regexp_extract_all(html,
        'href="([^"]*)"', 1)) AS target FROM pages)"""
    return {
        "t1_append": f"SELECT {_EVENTS} FROM events WHERE event_id % 2 = 0 UNION ALL SELECT "
        f"{_EVENTS.replace('props,', 'NULL AS props,')} FROM events WHERE event_id % 2 = 1",
        "t2_infer_schema": """SELECT key, 'BIGINT' AS type, count(*) AS row_count FROM (
            SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key""",
        "t3_delete_where": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
            o_orderpriority, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS removed
            FROM orders WHERE o_orderstatus <> 'F'""",
        "t4_sql": """SELECT event_type, count(*) AS n, max(value) AS top FROM events
            WHERE value > 5 GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3""",
        "t4_store_sql": _with(symbols=_all(SYMBOLS)) + """ SELECT s.kind, count(*) AS n,
            count(DISTINCT p.p_brand) AS brands FROM symbols s JOIN part p
            ON p.p_partkey = CAST(regexp_extract(s.file_path, 'm([0-9]+)', 1) AS BIGINT) GROUP BY s.kind""",
        "t5_export_import": "SELECT * FROM customer",
        "t5_json_and_parquet": "SELECT *, unnest(['json', 'parquet']) AS format FROM customer",
        "t5_rejects": """SELECT CASE WHEN c_custkey % 10 = 3 THEN 'reject' ELSE 'row' END AS kind,
            CASE WHEN c_custkey % 10 <> 3 THEN c_custkey END AS k, CASE WHEN c_custkey % 10 = 3
            THEN '{"k": x' || c_custkey || ', "c_name": "' || c_name || '"}' ELSE c_name END AS text FROM customer""",
        "t6_read_table": f"""SELECT {_EVENTS} FROM (SELECT * FROM events WHERE
            ts >= TIMESTAMP '2024-01-03 00:00:00' ORDER BY ts, event_id LIMIT 500 OFFSET 20)""",
        "t7_table_stats": stats,
        "v1_latest_by_key": f"""SELECT {_EVENTS} FROM (SELECT * FROM events QUALIFY row_number()
            OVER (PARTITION BY user_id ORDER BY events.ts DESC, event_id DESC) = 1)""",
        "v2_apply_changes": """SELECT c_custkey, c_name, c_nationkey, c_acctbal + CASE WHEN
            c_custkey % 10 = 0 THEN 1 ELSE 0 END AS c_acctbal, c_mktsegment FROM customer
            UNION ALL SELECT -c_custkey, 'new', NULL, 0.0, NULL FROM customer
            WHERE c_custkey % 100 = 7""",
        "v3_version_history": """SELECT event_id, user_id, value, row_number() OVER w
            AS version_no, lag(value) OVER w AS previous_value FROM events
            WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
        "v4_cascade_delete": """SELECT 'customer' AS table_name, count(*) AS removed FROM customer
            WHERE c_custkey % 10 = 3 UNION ALL SELECT 'orders', count(*) FROM orders
            WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3)
            UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (
            SELECT o_orderkey FROM orders WHERE o_custkey IN (
            SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3))""",
        "i1_scan_files": " UNION ALL ".join(
            f"SELECT '{n}' AS name, TRUE AS has_bytes" for n in names),
        "i3_file_facts": """SELECT doc_id, sha256(text) AS content_hash,
            CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS line_count,
            CAST(strlen(text) AS BIGINT) AS byte_size FROM documents""",
        "g1_page_fan_in": links + """ SELECT target, count(*) AS links,
            count(DISTINCT page_id) AS fan_in FROM links GROUP BY target""",
        "g1_page_fan_out": links + """ SELECT page_id, count(*) AS links,
            count(DISTINCT target) AS fan_out FROM links GROUP BY page_id""",
        "m1_metadata": """SELECT key, value FROM (SELECT event_type || '-' || (user_id % 10)
            AS key, CAST(value AS VARCHAR) AS value, event_id FROM events) QUALIFY row_number()
            OVER (PARTITION BY key ORDER BY event_id % 2, event_id DESC) = 1""",
    }


def _documents() -> dict[str, str]:
    base = "WITH " + DOCUMENTS
    return {
        "d1_index_documents": base + """ SELECT project_id, file_path, doc_type, title, format,
            word_count, content_hash FROM docs""",
        "d1_store_documents": base + """, f AS (SELECT *, doc_id % 9 = 0 AS failed,
              doc_id % 9 <> 0 AND (doc_id % 7 = 3 OR doc_id % 10 = 0) AS todo FROM docs)
            SELECT unnest(['files_indexed', 'files_skipped', 'files_failed', 'total_words', 'stored']) AS metric,
              unnest([count(*) FILTER (todo), count(*) FILTER (NOT todo AND NOT failed), count(*) FILTER (failed),
                CAST(sum(word_count + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) FILTER (todo) AS BIGINT),
                count(*) FILTER (NOT failed OR doc_id % 7 <> 3)]) AS value FROM f""",
        "d1_document_totals": base + """ SELECT count(*) AS files_indexed,
            CAST(sum(word_count) AS BIGINT) AS total_words FROM docs""",
        "d2_select_documents": base + " SELECT file_path FROM docs",
        "d3_list_documents": base + """ SELECT file_path, doc_type, title, format, word_count
            FROM docs WHERE project_id = 'src3' AND doc_type = 'api'""",
        "d4_get_documents": base + """ SELECT file_path, title, content FROM docs
            WHERE project_id = 'src4' AND doc_id % 3 = 0""",
        "d5_search_documents": base + """ SELECT * FROM (SELECT file_path, title, word_count,
            CAST((length(lower(content)) - length(replace(lower(content), 'the', ''))) // 3
            AS BIGINT) AS hits FROM docs WHERE project_id = 'src5') WHERE hits > 0""",
        "d5_search_by_index": base + """ SELECT needle, file_path, title, word_count,
            CAST((length(lower(content)) - length(replace(lower(content), lower(needle), '')))
            // length(needle) AS BIGINT) AS hits
            FROM docs, (VALUES ('The'), ('Heading 1'), ('ea')) n(needle)
            WHERE project_id = 'src5' AND contains(lower(content), lower(needle))""",
        "d6_document_breakdown": base + """ SELECT doc_type, count(*) AS documents,
            CAST(sum(word_count) AS BIGINT) AS words FROM docs GROUP BY doc_type""",
        "d6_concept_coverage": base + """ SELECT t.term, count(d.file_path) AS documents FROM
            (VALUES ('the'), ('heading'), ('und'), ('eaux'), ('nowhere')) t(term)
            LEFT JOIN docs d ON contains(lower(d.content), t.term) GROUP BY t.term""",
        "i4_diff_files": base + """ SELECT project_id, file_path, CASE WHEN doc_id % 7 = 3
            THEN 'file_not_found' WHEN doc_id % 9 = 0 THEN 'unsupported_language'
            WHEN doc_id % 10 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM files
            UNION ALL SELECT project_id, file_path || '.new.md', CASE WHEN doc_id % 9 = 0
            THEN 'unsupported_language' ELSE 'new' END FROM files WHERE doc_id % 50 = 1""",
        "i7_stream_index": base + r""", last AS (
            SELECT regexp_replace(file_path, '\.\w+$', '.py') AS file_path, content
              || CASE WHEN doc_id % 10 = 0 THEN chr(10) || 'edited' ELSE '' END AS content
            FROM files) SELECT file_path, sha256(content) AS content_hash,
            CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS BIGINT)
              AS line_count, CAST(strlen(content) AS BIGINT) AS byte_size
            FROM last WHERE file_path LIKE '%.py'""",
    }


def _sessions() -> dict[str, str]:
    base = "WITH " + MESSAGES
    return {
        "s1_append_messages": base + """ SELECT session_id, turn, role, row_number() OVER (
            PARTITION BY session_id ORDER BY turn) AS sequence_number FROM messages""",
        "s2_session_rollup": base + " " + _ROLLUP,
        "s3_session_messages": base + """ SELECT session_id, turn AS sequence_number, role,
            content FROM messages WHERE project_id = '2' QUALIFY row_number() OVER (
            PARTITION BY session_id ORDER BY turn) <= 4""",
        "s4_list_sessions": base + f""" SELECT session_id, 'chat ' || session_id AS title,
            message_count, token_count FROM ({_ROLLUP}) WHERE project_id = '3'
            ORDER BY CAST(session_id AS BIGINT) DESC LIMIT 50""",
        "s5_archive_sessions": base + f""" SELECT session_id, message_count, CAST(CASE WHEN
            CAST(session_id AS BIGINT) % 5 = 1 THEN 1710000000 END AS BIGINT) AS archived,
            CAST(CASE WHEN CAST(session_id AS BIGINT) % 5 = 1 THEN 1710000000
            ELSE 1704070000 + CAST(session_id AS BIGINT) END AS BIGINT) AS updated
            FROM ({_ROLLUP})""",
        "s6_stream_session_rollup": base + " " + _ROLLUP,
        "s6_compacted_rollup": base + " " + _ROLLUP,
        "s6_stream_sessions": """WITH cut AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (
              PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
            numbered AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS visit FROM cut)
            SELECT user_id, count(*) AS events, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at,
              CAST(1 AS BIGINT) AS too_late FROM numbered GROUP BY user_id, visit""",
        "s6_stream_activity": """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type,
            count(*) AS messages FROM events GROUP BY 1, 2""",
    }


def _todos() -> dict[str, str]:
    base = "WITH " + TODOS
    return {
        "k1_upsert_todos": base + """ SELECT todo_id, title, CASE WHEN n % 10 = 0 THEN 'done'
            ELSE status END AS status, priority, project_id FROM todos UNION ALL
            SELECT 'new-' || todo_id, 'fresh', 'open', 'medium', NULL FROM todos
            WHERE n % 10 = 1""",
        "k2_list_todos": base + r""" SELECT todo_id, priority, assigned_to, 'high' AS tags,
            CAST(created_at AS VARCHAR) AS created_at FROM todos
            WHERE project_id = '4' AND status = 'O' AND priority = '2-HIGH'""",
        "k3_delete_todos": base + """ SELECT todo_id, status, priority FROM todos
            WHERE NOT (status = 'F' AND priority = '5-LOW')""",
    }


def expected() -> dict[str, str]:
    return {**_tables(), **_code(), **_documents(), **_sessions(), **_todos(),
            **sql_checks.expected()}
