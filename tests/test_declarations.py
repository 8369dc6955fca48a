"""Declarations of source files: the linear scan, nested containers, and files read off by hand."""

import time

import duckdb
import pytest

from pergola.functions import declarations
from pergola.operators import chunking
from pergola.plans import fixtures

#: What the fixture's files declare, read off by hand.
CODE_SQL = """SELECT * FROM (VALUES
('src/store.py', 1, 2, 'module', NULL, NULL, '// imports: import os; from sys import path'), ('src/store.py', 4, 6, 'function', 'small', NULL, '// imports: import os; from sys import path'),
('src/store.py', 9, 31, 'class', 'Store', NULL, '// imports: import os; from sys import path'), ('src/store.py', 10, 20, 'function', 'get', 'Store', '// imports: import os; from sys import path'),
('src/store.py', 21, 31, 'function', 'put', 'Store', '// imports: import os; from sys import path'), ('src/store.py', 33, 33, 'module', NULL, NULL, '// imports: import os; from sys import path'),
('web/board.ts', 1, 2, 'module', NULL, NULL, '// imports: import { draw } from "./draw";'), ('web/board.ts', 3, 32, 'class', 'Board', NULL, '// imports: import { draw } from "./draw";'),
('web/board.ts', 4, 6, 'method', 'constructor', 'Board', '// imports: import { draw } from "./draw";'), ('web/board.ts', 7, 19, 'method', 'render', 'Board', '// imports: import { draw } from "./draw";'),
('web/board.ts', 20, 31, 'method', 'width', 'Board', '// imports: import { draw } from "./draw";'), ('web/board.ts', 34, 36, 'function', 'openBoard', NULL, '// imports: import { draw } from "./draw";'),
('web/board.ts', 37, 37, 'interface', 'Shape', NULL, '// imports: import { draw } from "./draw";'),
('cmd/server.go', 1, 3, 'module', NULL, NULL, '// imports: import "fmt"'), ('cmd/server.go', 5, 7, 'method', 'Start', NULL, '// imports: import "fmt"'), ('cmd/server.go', 9, 12, 'interface', 'Server', NULL, '// imports: import "fmt"'),
('src/tree.rs', 3, 5, 'class', 'Tree', NULL, '// imports: use std::fmt;'), ('src/tree.rs', 7, 11, 'class', 'Tree', NULL, '// imports: use std::fmt;'), ('src/tree.rs', 13, 13, 'function', 'is_brace', NULL, '// imports: use std::fmt;'),
('src/broken.py', 1, 2, 'block', NULL, NULL, 'def broken(:'), ('notes.txt', 1, 1, 'block', NULL, NULL, 'Only some words about nothing in particular.'), ('guide.md', 1, 2, 'documentation', 'Guide', NULL, '# Guide')
) AS t(path, start_line, end_line, kind, symbol, parent_symbol, second)"""


def test_files_read_off_by_hand(spark):
    found = chunking.chunks(fixtures.SOURCES.frame(spark), 20, 5).collect()
    got = [(r.path, r.start_line, r.end_line, r.kind, r.symbol, r.parent_symbol, (r.content.split("\n") + [None])[1]) for r in found]
    assert sorted(got, key=repr) == sorted(duckdb.sql(CODE_SQL).fetchall(), key=repr)


def declared(text, language, most=120):
    return [(d["first"] + 1, d["last"] + 1, d["kind"], d["symbol"], d["parent"]) for d in declarations.outline_of(text, language, most)["found"]]


SCRIPT = """import a from 'a'
const one = 1
const two = [
  1,
  '}'
]
let three = one
  .map(x => x)
run(three)
class A
  extends B {
  x = 5
  static go(a, b) {
    return a
  }
  get
  size() {
    return 1
  }
}
export type T = {
  a: string
}
type U = A | B
function f()
{
  return /x/
}
async function g(a,
  b) {
  return 2
}
const h = async () => {
  await g()
}
module.exports = { f }
"""


def test_line_ended_statements():
    assert declared(SCRIPT, "typescript", 5) == [
        (2, 2, "block", "one", None), (3, 6, "block", "two", None), (7, 8, "block", "three", None), (10, 20, "class", "A", None), (13, 15, "method", "go", "A"), (17, 19, "method", "size", "A"),
        (21, 23, "interface", "T", None), (24, 24, "interface", "U", None), (25, 28, "function", "f", None), (29, 32, "function", "g", None), (33, 35, "block", "h", None),
    ]


def test_nested_containers():
    java = "class Outer {\n  @Override\n  public void go(int a) {\n    run();\n  }\n  static class Inner {\n    void deep() {\n      x();\n    }\n    class Third {\n      int f() {\n        return 1;\n      }\n    }\n  }\n}\n"
    assert declared(java, "java", 3) == [(1, 16, "class", "Outer", None), (3, 5, "method", "go", "Outer"), (6, 15, "class", "Inner", "Outer"), (7, 9, "method", "deep", "Inner"), (10, 14, "class", "Third", "Inner"), (11, 13, "method", "f", "Third")]
    assert [d[2:] for d in declared(java, "java", 100)] == [("class", "Outer", None)]
    python = "class A:\n    class B:\n        def f(self):\n            return 1\n\n    def g(self):\n        return 2\n"
    assert [d[3:] for d in declared(python, "python", 2)] == [("A", None), ("B", "A"), ("f", "B"), ("g", "A")]


@pytest.mark.parametrize(
    ("language", "text", "last"),
    [
        ("javascript", "const data = [\n" + "".join(f"  'a{i}',\n" for i in range(40_000)) + "]\nfunction last() {\n  return 1\n}\n", "last"),
        ("typescript", "const a = {\n" + "".join(f"  k{i}: [{i}, (x) => {{ return {i} }}],\n" for i in range(9000)) + "}\nclass Last {\n}\n", "Last"),
        ("go", "package a\nvar data = []int{\n" + "".join(f"\t{i},\n" for i in range(60_000)) + "}\n\nfunc last() {\n}\n", "last"),
        ("cpp", "int x = 1 +\n" * 30_000 + ";\nint last() { return 0; }\n", "last"),
        ("kotlin", "val a = listOf(\n" + "  1,\n" * 80_000 + ")\nfun last() {\n}\n", "last"),
        ("java", "class A {\n" + "".join(f"  int f{i}() {{ return {i}; }}\n" for i in range(12_000)) + "}\nclass Last {\n}\n", "Last"),
    ],
)
def test_long_files_take_linear_time(language, text, last):
    began = time.process_time()
    found = declarations.outline_of(text, language, 120)["found"]
    took = time.process_time() - began
    assert found[-1]["symbol"] == last and len(text) > 270_000
    assert took < 4  # a second on a machine of usual speed


def test_broken_files_give_what_they_can():
    for text in ("class A {", "function f( {\n}\n", "}}}}", "((((", "class A {\n  f() {\n", "const", "`", "/*", "", None):
        for language in declarations.GRAMMARS:
            declarations.outline_of(text, language, 5)


def test_outlines_are_python_objects_of_a_few_files_at_once():
    import pyarrow as pa

    texts = ["def a():\n    return 1\n", None, "class B:\n    def c(self):\n        return 2\n", "x = 1\n" * (declarations.BYTES // 4)] * 200
    parts = list(declarations.outlines(pa.array(texts[:3] * 200 + texts[:4]), pa.array(["python"] * 604), 20))
    assert sum(map(len, parts)) == 604 and max(map(len, parts)) <= declarations.ROWS and len(parts[-1]) == 1
    assert [f["found"][0]["symbol"] for f in parts[0].to_pylist()[::3]] == ["a"] * len(parts[0][::3])
    assert parts[0].to_pylist()[1] == {"imports": None, "found": None}
