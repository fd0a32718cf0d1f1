import ast

import pytest

from codelake.plans.index import Extraction

SAMPLE = '''#!/usr/bin/env python
"""Docstring with a fake

class Hidden:
    pass
"""
from __future__ import annotations
import os.path as osp, re
from .pkg.mod import (a as b,  # (comment
                      c)
from ..up import *
if True:
    import late

X = [
    1,
  2]
TEXT = "def no(): # not"
É = f"{osp} {TEXT!r:>10} {{x}}"; y: int = 3


@deco.one(
    "a)",
    key=[1, 2],
)
@two
async def first(a, b: dict[str, int] = {"k": (1, 2)}, *, c: "Q" = None) -> list[str]:
    r"""raw \\\\"""
    def inner(z=lambda q: (q, 1)):
        return z
# comment at zero
    if a:
        class Deep(Base[int], mixin(1), meta.X, metaclass=M):

            def run(self): return self.go(
                1)

        x = 1
    else:
        async def other(): pass
    return [
      a
    ]

class Empty: ...
class Last(object):
\tdef tabbed(self):
\t\tpass
    
\t@property
\tdef two_words(self) -> "é": return 'héé' + self.name  # trailing
__all__ = ["first", 'Last',  # "no"
           "Empty"]
value = other = first(X) \\
    + Last()
def tail(
  q
): return q
'''


def walk(tree):
    """(qualified name, kind, first line, last line) by the standard parser."""
    out = []

    def visit(node, names, in_class):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(child, ast.ClassDef)
                kind = "class" if cls else "method" if in_class else "function"
                out.append((".".join([*names, child.name]), kind, child.lineno, child.end_lineno,
                            child.col_offset, child.end_col_offset,
                            None if cls or not ast.get_docstring(child) else True))
                visit(child, [*names, child.name], cls)
            else:
                visit(child, names, in_class)
    visit(tree, [], False)
    return sorted(out)


@pytest.fixture
def work(files):
    return Extraction(files({"src/a.py": SAMPLE, "src/empty.py": "", "b.py": "x = 1\n"}))


def rows(df, path="src/a.py"):
    return df.where(df.file_path == path).orderBy("start_line").collect()


def test_definitions_match_the_standard_parser(work):
    got = sorted((r.qualified_name, r.kind, r.start_line, r.end_line, r.start_col, r.end_col,
                  True if r.docstring and r.kind != "class" else None)
                 for r in rows(work.python("symbols")))
    assert got == walk(ast.parse(SAMPLE))


def test_symbol_details(work):
    s = {r.name: r for r in rows(work.python("symbols"))}
    assert s["first"].signature == ('first(a, b: dict[str, int] = {"k": (1, 2)}, *, '
                                    'c: "Q" = None) -> list[str]')
    assert [" ".join(d.split()) for d in s["first"].decorators] == [
        '@deco.one( "a)", key=[1, 2], )', "@two"]
    assert s["first"].is_async and not s["inner"].is_async
    assert s["Deep"].signature == "class Deep" and s["Last"].signature == "class Last(object)"
    assert s["two_words"].decorators == ["@property"] and s["tabbed"].decorators == []
    assert s["run"].parent_symbol_id == s["Deep"].symbol_id
    assert s["Deep"].parent_symbol_id == s["first"].symbol_id


def test_imports(work):
    got = [(r.module_path, r.imported_names, r.alias, r.relative_level, r.start_line)
           for r in rows(work.python("imports"))]
    assert got == [("os.path", [], "osp", 0, 8), ("re", [], None, 0, 8),
                   (".pkg.mod", ["a", "c"], None, 1, 9), ("..up", [], None, 2, 11),
                   ("late", [], None, 0, 13)]


def test_exports_and_types(work):
    lines = SAMPLE.split("\n")
    at = next(i for i, t in enumerate(lines, 1) if t.startswith("__all__"))
    assert [(r.exported_name, r.start_line) for r in rows(work.python("exports"))] == [
        ("first", at), ("Last", at), ("Empty", at + 1)]
    types = [(r.name, r.type_expression) for r in rows(work.python("types"))]
    assert ("X", "[\n    1,\n  2]") in types and ("TEXT", '"def no(): # not"') in types
    notes = [e for n, e in types if n == ""]
    assert sorted(notes) == sorted(["dict[str, int]", '"Q"', "list[str]", '"é"'])


def test_identifiers_match_the_standard_parser(work):
    """Loads, stores and direct calls agree wherever the standard parser has a Name."""
    got = {(r.name, r.start_line, r.start_col): r.kind for r in rows(work.python("references"))}
    tree = ast.parse(SAMPLE)
    calls = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    for n in ast.walk(tree):
        if not isinstance(n, ast.Name):
            continue
        where = (n.id, n.lineno, n.col_offset)
        if n.id == "TEXT" and n.lineno == 18:
            continue
        assert where in got, where
        if id(n) in calls:
            assert got[where] == "call", where
        elif isinstance(n.ctx, ast.Load):
            assert got[where] == "read", where
        else:
            assert got[where] == "write", where


def test_empty_and_trivial_files(work):
    scopes = work.table("scopes")
    assert [(r.kind, r.start_line, r.end_line) for r in rows(scopes, "src/empty.py")] == [
        ("module", 1, 1)]
    assert [(r.kind, r.end_line) for r in rows(scopes, "b.py")] == [("module", 2)]
    assert rows(work.table("symbols"), "b.py") == []


def test_no_python_in_the_plan_and_one_shuffle(work):
    for entity in ("symbols", "types", "imports", "references"):
        plan = work.python(entity)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
        assert plan.count("Exchange hashpartitioning") == 1, entity


@pytest.mark.parametrize("levels", [3, 70, 190])
def test_brackets_of_any_depth_match_the_standard_parser(files, levels):
    deep = "dict[str, " * levels + "int" + "]" * levels
    value = "(" * levels + "1, 2" + ",)" * levels
    text = (f"def one(a: {deep}, b=f({value[1:-2]}), *c: Q[{deep[10:-1]}]) -> {deep}:\n    return a\n"
            f"class Two(Base[{deep[10:-1]}], Plain):\n    y: {deep} = 3\n    z: int = {value}\nAlias = {deep}\n")
    tree = ast.parse(text)
    notes = sorted(ast.get_source_segment(text, n) for n in [
        *(a.annotation for f in ast.walk(tree) if isinstance(f, ast.FunctionDef)
          for a in [*f.args.args, f.args.vararg] if a.annotation),
        *(n.annotation for n in ast.walk(tree) if isinstance(n, ast.AnnAssign)), tree.body[0].returns])
    out = Extraction(files({"a.py": text}))
    found = out.table("types").collect()
    assert sorted(r.type_expression for r in found if r.kind == "annotation") == notes
    assert [r.type_expression for r in found if r.kind == "alias"] == [deep]
    signature = {r.name: r.signature for r in out.table("symbols").collect()}
    assert signature == {"one": text[len("def "):text.index(":\n")], "Two": "class Two(Plain)"}


def test_unbalanced_and_long_literals(files):
    rows = ", ".join(f"({i}, [{i}])" for i in range(20_000))
    out = Extraction(files({"a.py": f"X: list[int] = [{rows}]\ndef open(a: list[int\n", "b.py": "Y: int = 1)]\n"}))
    found = {(r.file_path, r.kind, r.type_expression[:9]) for r in out.table("types").collect()}
    assert found >= {("a.py", "annotation", "list[int]"), ("a.py", "alias", "[(0, [0])"), ("b.py", "annotation", "int")}
