import pytest
from pyspark.sql import functions as F

from codelake.plans.index import Extraction

JS = '''/* class Fake { */
import def, { a, b as c } from "./mod.js";
import * as ns from 'ns'
import './side'
const { x, y: z } = require("lib"), w = 1
const re = /["'{]/g, tpl = `a ${x} { ${"}"} b`

export default class Main extends Base(1) {
  field = 5
  #priv() { return { k: 1, [x]: 2 }; }
  static async *gen(p = {}) {
    for (const q of p) { await q }
    if (x) { y() } else { z() }
  }
  get size() { return this.list.map(v => ({ v, n: v.n })) }
}

async function outer(a, { b, c } = {}) {
  function inner() {
    return () => a
  }
  const arrow = async (k) =>
    k + 1
  let fn = function named() { return new Main(a) }
  const _one = u => u
  return inner, arrow
}
export { outer, ns as names }
export * from './all'
var last = (m, n) => m
  .go(n)
'''
TS = '''import { type T1, T2 } from "./types"
export type Fn = (a: number) => void
type U<T> = { x: T } | null;
interface I extends J {
  m(a: string): void
}
abstract class A {}
export class S<T> implements I {
  private count: number = 0
  constructor(private readonly dep: Dep) {}
  m(a: string): void { this.use<T>(a as T) }
  other(): Promise<void>;
}
const f = (p: T2): Promise<U> => {
  return g(p)
}
'''


@pytest.fixture
def work(files):
    return Extraction(files({"a.js": JS, "b.ts": TS, "c.tsx": "", "d.mjs": "}{)("}))


def rows(df, path):
    return df.where(df.file_path == path).orderBy("start_line").collect()


def test_symbols(work):
    got = {(r.qualified_name, r.kind, r.start_line, r.end_line, r.is_async, r.is_static,
            r.visibility) for r in rows(work.script("symbols"), "a.js")}
    assert got == {
        ("Main", "class", 8, 16, False, False, "public"),
        ("Main.gen", "method", 11, 14, True, True, "public"),
        ("Main.priv", "method", 10, 10, False, False, "public"),
        ("Main.size", "method", 15, 15, False, False, "public"),
        ("outer", "function", 18, 27, True, False, "public"),
        ("outer.inner", "function", 19, 21, False, False, "public"),
        ("outer.arrow", "function", 22, 23, True, False, "public"),
        ("outer.fn", "function", 24, 24, False, False, "public"),
        ("outer._one", "function", 25, 25, False, False, "private"),
        ("last", "function", 30, 31, False, False, "public"),
    }


def test_typescript_symbols_and_types(work):
    got = {(r.qualified_name, r.kind, r.start_line, r.end_line)
           for r in rows(work.script("symbols"), "b.ts")}
    assert got == {("S", "class", 8, 13), ("S.constructor", "method", 10, 10),
                   ("S.m", "method", 11, 11), ("f", "function", 14, 16)}
    types = [(r.name, r.kind, r.type_expression, r.start_line, r.end_line)
             for r in rows(work.script("types"), "b.ts")]
    assert types == [("Fn", "alias", "(a: number) => void", 2, 2),
                     ("U", "alias", "{ x: T } | null", 3, 3), ("I", "interface", "interface", 4, 6)]


def test_imports_and_exports(work):
    got = [(r.module_path, r.imported_names, r.import_kind)
           for r in rows(work.script("imports"), "a.js")]
    assert got == [("./mod.js", ["a", "b"], "import"), ("ns", [], "import"),
                   ("./side", [], "import"), ("lib", [], "require")]
    assert [r.imported_names for r in rows(work.script("imports"), "b.ts")] == [["T1", "T2"]]
    exports = [(r.exported_name, r.export_kind) for r in rows(work.script("exports"), "a.js")]
    assert sorted(exports) == [("default", "default"), ("ns", "direct"), ("outer", "direct")]


def test_scopes(work):
    got = [(r.kind, r.name, r.start_line, r.end_line, r.depth)
           for r in rows(work.script("scopes"), "a.js") if r.depth]
    want = [("class", "Main", 8, 16, 1), ("function", None, 15, 15, 2),
            ("function", "outer", 18, 27, 1), ("function", "inner", 19, 21, 2),
            ("function", None, 20, 20, 3), ("function", None, 22, 23, 2),
            ("function", None, 24, 24, 2), ("function", None, 25, 25, 2),
            ("function", None, 30, 31, 1)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_references(work):
    refs = {(r.name, r.start_line): r.kind for r in rows(work.script("references"), "a.js")}
    assert refs[("inner", 26)] == "read" and refs[("y", 13)] == "call"
    assert refs[("last", 30)] == "write" and refs[("m", 30)] == "read"
    assert ("size", 15) not in refs and ("field", 9) not in refs and ("go", 31) not in refs
    assert refs[("x", 6)] == "read" and ("g", 6) not in refs
    ts = {(r.name, r.start_line) for r in rows(work.script("references"), "b.ts")}
    assert ("Dep", 10) not in ts and ("g", 15) in ts and ("J", 4) not in ts


def test_broken_text_gives_no_error(work):
    assert rows(work.table("scopes"), "d.mjs")[0].kind == "module"
    assert rows(work.table("symbols"), "c.tsx") == []


@pytest.mark.parametrize("blank", ["", " ", "   ", " " * 4, " " * 10, "\t", "\t \t", "\n", "\n    "])
def test_literals_of_regular_expressions_after_any_blanks(files, blank):
    text = ("function one() { const r =" + blank + "/{['\"`/]/g; return r }\n"
            "const two = (x) => x.split(" + blank + "/[)}]/)\nexport { one, two }\n")
    work = Extraction(files({"a.js": text}))
    assert sorted(r.name for r in work.table("symbols").collect()) == ["one", "two"]
    assert sorted(r.exported_name for r in work.table("exports").collect()) == ["one", "two"]


def test_division_is_no_literal(files):
    text = "function f(a, b) {\n  const c = a / b, d = (a + b) / 2 / c\n  return [a] / { n: 1 }.n / g(c)\n}\nfunction g() {}\n"
    rows = Extraction(files({"a.ts": text})).table("symbols").collect()
    assert sorted((r.name, r.start_line, r.end_line) for r in rows) == [("f", 1, 4), ("g", 5, 5)]


def test_any_number_of_modifiers(files):
    text = ("class A {\n  public static override async go() {}\n  protected readonly static accessor public async *all() {}\n"
            "  x = 1\n  get one() { return 2 * this.two() }\n  two() {}\n  static() {}\n}\n")
    rows = {r.name: r for r in Extraction(files({"a.ts": text})).table("symbols").collect()}
    assert {n: (r.start_line, r.start_col, r.is_static, r.is_async) for n, r in rows.items() if n != "A"} == {
        "go": (2, 2, True, True), "all": (3, 2, True, True), "one": (5, 2, False, False), "two": (6, 2, False, False),
        "static": (7, 2, False, False)}


def test_tokens_sort_once_and_keep_their_columns(spark, files):
    """Columns past tabs, wide letters, blanks at line ends, and a file that is there twice."""
    from codelake.plans.lines import lines, spread, text_bytes, tokens

    both = files({"a.js": "\tlet é = f(1) ;\t \n\n  \x0bg(é,\t2)\n"})
    rows = lines(spread(both, text_bytes(both)), "script")
    got = [(r.line_no, r.tok, r.col, r.end_col) for r in tokens(rows).orderBy("line_no", "idx").collect()]
    assert got == [(1, "let", 1, 4), (1, "é", 5, 7), (1, "=", 8, 9), (1, "f", 10, 11), (1, "(", 11, 12), (1, "1", 12, 13),
                   (1, ")", 13, 14), (1, ";", 15, 16), (3, "g", 3, 4), (3, "(", 4, 5), (3, "é", 5, 7), (3, ",", 7, 8),
                   (3, "2", 9, 10), (3, ")", 10, 11)]
    plan = tokens(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2  # one of lines, one of tokens


def test_tasks_follow_the_text(spark, files):
    from codelake.plans.lines import BYTES_PER_TASK, spread, text_bytes

    some = files({"a.js": "x" * 1000, "b.js": "é" * 500, "c.js": None})
    assert text_bytes(some) == 2000
    assert spread(some, 9 * BYTES_PER_TASK).rdd.getNumPartitions() == 9


def test_windows_carry_the_text_of_one_token(spark, files):
    """Words are told apart by their codes, and rows hold no text but their own token and a name after it."""
    from codelake.plans.script_rules import KEYWORDS, _is, _named, coded

    words = spark.createDataFrame([(w,) for w in [*KEYWORDS, "é1", "$x", '"\'\'', "=>", "{", "?.", "1a"]], "tok string")
    rows = words.select("tok", coded(F.col("tok")).alias("code"), F.lit(None).cast("bigint").alias("none"))
    got = rows.select("tok", _named("code").alias("named"), _is("code", *KEYWORDS).alias("key"),
                      _is(F.col("code"), "=>", "{").alias("sign"), _is("none", "=>").alias("nothing")).collect()
    assert all(r.named == (r.tok[0].isalpha() or r.tok[0] == "$") and r.key == (r.tok in KEYWORDS)
               and r.sign == (r.tok in ("=>", "{")) and not r.nothing for r in got)
    found = Extraction(files({"a.ts": "class A {}\nlet b = () => 1\n"}))
    texts = {f.name for f in found.script_tokens.schema if f.dataType.simpleString() == "string"}
    assert texts - {"project_id", "file_path"} == {"tok", "next_tok"}
    assert {r.next_tok for r in found.script_tokens.collect()} == {None, "A"}
