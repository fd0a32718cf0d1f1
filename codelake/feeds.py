"""Inputs derived from the given tables, by Spark, for queries, tests and the benchmark.

The code corpus is one templated source file per row of `part`: language by key modulo 3, a
varying number of filler lines by size, names and imports carrying the keys of this part ({k})
and of the part three before it ({j}), which is in the same language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILLER = "@filler"

PYTHON_LINES = '''"""Module for part {k}.

def not_code(): is only text

"""
import os
import json as js, sys
from collections import (
    OrderedDict,
    defaultdict as dd,  # default (one
)
from .m{j} import size_{j}, Part{j}
from . import *

__all__ = [
    "Part{k}",
    'size_{k}',
]

Alias{k} = dict
LIMIT: int = {n}


@register("{b}")  # comment with def fake(): in it
class Part{k}(Base, other.Other, metaclass=Meta):
    """A part of {b}."""

    kind: str = "x"

    class Inner{k}:
        def deep(self):
            return 1

    @property
    @cached(1)
    def size(self) -> int:
        """Size # not a comment."""
        total = {n}
@filler
        return total

    async def _load(
        self,
        path: str,
        limit: int = 10,
    ) -> Part{j}:
        text = f"{path}: {limit}"
        return helper(text)

    def __hide(self): return None

# comment at column zero

def size_{k}(value: int, *args, flag: bool = False) -> "Part{k}":
    def inner(x):
        return x
    total = size_{j}(value)
    return inner(total)
'''.split("\n")
PYTHON_FILLER = "        total = total + 1"

JAVASCRIPT_LINES = '''// module {k}: function fake() { }
import { size{j}, Part{j} as Other } from './m{j}';
import fs from "fs";
import {
  join,
  resolve,
} from 'path';
const lib = require('lib{j}');

/* class NotCode {
} */
export class Part{k} extends Other {
  constructor(name) {
    super(name);
    this.name = `part ${name} {`;
  }

  static async load(path) {
    let total = {n};
@filler
    if (total > 3) {
      total = size{j}(total);
    }
    return total;
  }

  get label() { return "a } brace"; }
}

function size{k}(value, rest) {
  const inner = (x) => x + 1;
  const _hidden = async function (y) {
    return inner(y);
  };
  return rest.map(item => {
    return _hidden(item);
  });
}

export async function main{k}() {
  return size{k}(fs, join);
}

export { size{k}, lib as library };
export default Part{k};
'''.split("\n")
JAVASCRIPT_FILLER = "    total = total + 1;"

TYPESCRIPT_LINES = '''import type { Shape{j} } from './m{j}';
import 'reflect';

export type Key{k} = string | number;
type Mode = 'a'
  | 'b';

export interface Shape{k} {
  size: number;
  name: string;
}

class Store{k} implements Shape{k} {
  size: number = {n};
@filler
  static make(n: number): Store{k} {
    return new Store{k}();
  }
}

export const build{k} = async (key: Key{k}) => {
  const s = Store{k}.make(1);
  return wrap(s, key);
};

export { Store{k} as Store };
'''.split("\n")
TYPESCRIPT_FILLER = "  // filler { line"

TEMPLATES = {
    0: ("python", "py", PYTHON_LINES, PYTHON_FILLER),
    1: ("javascript", "js", JAVASCRIPT_LINES, JAVASCRIPT_FILLER),
    2: ("typescript", "ts", TYPESCRIPT_LINES, TYPESCRIPT_FILLER),
}


def _content(lines: list[str], filler: str):
    """The template as one column: constant text between the values of the row."""
    text = "\n".join(lines).replace(FILLER + "\n", FILLER)
    values = {
        "{k}": F.col("p_partkey").cast("string"),
        "{j}": F.greatest(F.col("p_partkey") - 3, F.col("p_partkey") % 3).cast("string"),
        "{n}": F.col("p_size").cast("string"),
        "{b}": F.col("p_brand"),
        FILLER: F.repeat(F.lit(filler + "\n"), F.col("p_size") % 4),
    }
    pieces, rest = [], text
    while rest:
        hits = [(rest.index(m), m) for m in values if m in rest]
        at, mark = min(hits) if hits else (len(rest), "")
        if at:
            pieces.append(F.lit(rest[:at]))
        if mark:
            pieces.append(values[mark])
        rest = rest[at + len(mark):]
    return F.concat(*pieces)


def corpus(part: DataFrame) -> DataFrame:
    """(project_id, file_path, content): thirty files per project.

    The rows are spread before texts are made of them: a small file of them would be one task."""
    tasks = int(part.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    choice = F.col("p_partkey") % 3
    content = ending = None
    for i, (_, suffix, lines, filler) in TEMPLATES.items():
        body = _content(lines, filler)
        content = F.when(choice == i, body) if content is None else content.when(choice == i, body)
        end = F.lit(suffix)
        ending = F.when(choice == i, end) if ending is None else ending.when(choice == i, end)
    return part.select("p_partkey", "p_size", "p_brand").repartition(tasks, "p_partkey").select(
        F.concat(F.lit("proj-"), F.floor(F.col("p_partkey") / 30).cast("string"))
        .alias("project_id"),
        F.concat(F.lit("src/m"), F.col("p_partkey").cast("string"), F.lit("."), ending)
        .alias("file_path"),
        content.alias("content"))


def chained_files(part: DataFrame) -> DataFrame:
    """(project_id, file_path, content): files of a project that import one name from each other in a row.

    The first of thirty defines it, the others pass it on and use it; `loop` goes round in a circle, `only` is
    defined by one file alone and `twice` by two."""
    k, place = F.col("p_partkey"), F.col("p_partkey") % 30
    first = F.concat(F.lit("from .m"), (k + 1).cast("string"), F.lit(
        " import loop\ndef thing():\n    return 1\ndef twice(): return 2\n"))
    rest = F.concat(F.lit("from .m"), (k - 1).cast("string"), F.lit(" import thing, loop\ndef use_"), k.cast("string"),
                    F.lit("():\n    thing()\n    only()\n    loop()\n    twice()\n"))
    more = F.lit("def only():\n    twice()\ndef twice(): return 3\n")
    content = F.when(place == 0, first).when(place == 7, F.concat(rest, more)).otherwise(rest)
    return part.select(
        F.concat(F.lit("proj-"), F.floor(k / 30).cast("string")).alias("project_id"),
        F.concat(F.lit("m"), k.cast("string"), F.lit(".py")).alias("file_path"), content.alias("content"))


def projects(part: DataFrame) -> DataFrame:
    """Three versions of each project of the corpus; the newest has the highest commit."""
    ids = part.select(F.floor(F.col("p_partkey") / 30).alias("n")).distinct()
    day = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    rows = ids.select("n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("v"))
    at = F.timestamp_seconds(F.unix_timestamp(day) + F.col("v") * 3600)
    text = F.lit(None).cast("string")
    return rows.select(
        F.concat(F.lit("proj-"), F.col("n").cast("string")).alias("project_id"),
        F.concat(F.lit("name-"), F.col("n").cast("string")).alias("project_name"),
        F.lit("/src").alias("root_path"), text.alias("description"), text.alias("version"),
        text.alias("git_remote"), F.lit("main").alias("git_branch"),
        F.concat(F.lit("c"), F.col("v").cast("string")).alias("git_commit"),
        at.alias("created_at"), at.alias("updated_at"), F.lit("{}").alias("metadata"))


def document_files(documents: DataFrame) -> DataFrame:
    """Files with documentation-like paths; some get a heading line."""
    i = F.col("doc_id").cast("string")
    turn = F.col("doc_id") % 10
    names = ["README_%.md", "CHANGELOG-%.md", "docs/%.rst", "api-%.md", "user-guide_%.txt",
             "CONTRIBUTING-%.md", "LICENSE-%", "docs/deep/note_%.html", "src/tool_%.py",
             "notes/%.markdown"]
    name = F.lit(None).cast("string")
    for n, pattern in enumerate(names):
        before, after = pattern.split("%")
        name = F.when(turn == n, F.concat(F.lit(before), i, F.lit(after))).otherwise(name)
    head = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("# Heading "), i, F.lit("\n")))
            .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Title "), i, F.lit("\n=======\n")))
            .otherwise(""))
    return documents.select(F.col("source").alias("project_id"),
                            F.concat_ws("/", "source", "lang", name).alias("file_path"),
                            F.concat(head, "text").alias("content"), "doc_id")


def changed_files(files: DataFrame) -> DataFrame:
    """A later state: every tenth text altered, every seventh file gone, some new ones."""
    i = F.col("doc_id")
    kept = files.where(i % 7 != 3).withColumn("content", F.when(
        i % 10 == 0, F.concat("content", F.lit("\nedited"))).otherwise(F.col("content")))
    added = files.where(i % 50 == 1).withColumn(
        "file_path", F.concat("file_path", F.lit(".new.md")))
    return kept.unionByName(added)


def messages(conversations: DataFrame) -> DataFrame:
    """Conversation turns as session messages; tokens are words."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("session_id"),
        (F.col("conv_id") % 5).cast("string").alias("project_id"), "role",
        F.col("text").alias("content"),
        F.regexp_count("text", F.lit(r"(?U)\S+")).cast("bigint").alias("token_count"),
        F.col("turn").cast("bigint").alias("turn"))


def todos(orders: DataFrame) -> DataFrame:
    """Orders as todo rows."""
    text, time = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return orders.select(
        F.col("o_orderkey").cast("string").alias("todo_id"),
        (F.col("o_custkey") % 10).cast("string").alias("project_id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"),
        text.alias("description"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), text.alias("file_path"),
        F.lit(None).cast("int").alias("line_number"),
        F.concat(F.lit("user-"), (F.col("o_custkey") % 7).cast("string")).alias("assigned_to"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
        done.alias("completed_at"), time.alias("due_date"),
        F.filter(F.split(F.lower("o_orderpriority"), "[^a-z]+"), lambda w: w != "").alias("tags"),
        F.lit("{}").alias("metadata"))
