"""Small tables for operators whose inputs the common tables don't have: as Spark rows and as SQL text, from one definition."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Fixture:
    """name; columns as 'name type'; rows."""

    name: str
    columns: tuple[tuple[str, str], ...]
    rows: tuple[tuple, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), ", ".join(f"{n} {t}" for n, t in self.columns))

    def sql(self, name: str | None = None) -> str:
        """A common table expression."""

        def literal(v, kind: str) -> str:
            if v is None:
                return f"NULL::{_duck(kind)}"
            text = "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
            return f"{text}::{_duck(kind)}"

        body = ", ".join("(" + ", ".join(literal(v, t) for v, (_, t) in zip(row, self.columns)) + ")" for row in self.rows)
        return f"{name or self.name}({', '.join(n for n, _ in self.columns)}) AS (VALUES {body})"


def _duck(kind: str) -> str:
    return {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}[kind]


GIT_DIFF = """diff --git a/src/api.py b/src/api.py
index 1111111..2222222 100644
--- a/src/api.py
+++ b/src/api.py
@@ -10,3 +10,6 @@ def handler():
 def handler(request):
-    return old_value
+    token = request.headers.get("token")
+    if not token:
+        return refuse(request)
+    return serve(request, token)
     # end
diff --git a/docs/guide.md b/docs/guide.md
new file mode 100644
--- /dev/null
+++ b/docs/guide.md
@@ -0,0 +1,2 @@
+# Guide
+Call the handler.
diff --git a/old.bin b/old.bin
deleted file mode 100644
Binary files a/old.bin and /dev/null differ
"""
PLAIN_DIFF = """--- a/one.sql\t2024-01-01
+++ b/one.sql\t2024-01-02
@@ -1,3 +1,2 @@ top
 select 1
--- a comment that looks like a header
 select 2
@@ -9 +8,2 @@
-select_three_times
+select_three_times
+select_four_times
\\ No newline at end of file
--- a/two.sql
+++ b/two.sql
@@ -1 +1 @@
-alpha_name beta_name
+alpha_name gamma_name alpha_name
"""
DIFFS = Fixture("diffs", (("diff_id", "string"), ("text", "string")), (("git", GIT_DIFF), ("plain", PLAIN_DIFF), ("prose", "no diff here"), ("empty", "")))

FINDINGS = Fixture(
    "findings",
    (("finding_id", "int"), ("path", "string"), ("line", "int"), ("severity", "string"), ("title", "string"), ("body", "string"), ("category", "string"), ("confidence", "double")),
    (
        (1, "src/api.py", 12, "critical", "Token is logged", "Don't.", "Security", 0.9),
        (2, "src/api.py", 15, "high", "Off by one", "Check it.", "correctness", 0.8),
        (3, "src/api.py", 900, "nit", "Style", "Spaces.", "", 0.7),
        (4, "src/api.py", 12, "low", "Unsure", "Maybe.", "style", 0.2),
        (5, "src/api.py", 13, " HIGH ", "Same thing", "a", "correctness", 0.6),
        (6, "src/api.py", 13, "high", "same THING", "b", "correctness", 0.9),
        (7, "docs/guide.md", None, "info", "", "No title here", "docs", 0.95),
        (8, "docs/guide.md", 1, "medium", "", "", "docs", 0.99),
        (9, "elsewhere.py", 77, "medium", "Untouched file", "c", "correctness", 0.5),
        (10, "src/api.py", 8, "medium", "Three above", "d", "correctness", 0.66),
    ),
)

def _drafts() -> tuple[tuple[int, str | None], ...]:
    """Brackets of every one, two and three parts out of places with one line and with two, lines alone, and words; then odd ones."""
    parts = ("a/quay.go:{n}", "b/tide.md:{m}-{n}", "{n}", "{m} – {n}", "as told")
    rows = [f"It is so [{', '.join(p.format(n=7 * k + 5, m=90 - 30 * k) for k, p in enumerate(own))}], they say." for size in (1, 2, 3) for own in itertools.product(parts, repeat=size)]
    return tuple(enumerate([*rows, "", None, "[a/quay.go:1] [5]", "[[a/quay.go:2]]", "[a/quay.go:]", "a/quay.go:3"], 1))


DRAFTS = Fixture("drafts", (("key", "int"), ("draft", "string")), _drafts())

CALLS = Fixture(
    "calls",
    (("call_id", "int"), ("model", "string"), ("prompt_tokens", "long"), ("completion_tokens", "long"), ("cached", "boolean")),
    (
        (1, "gemini-2.0-flash-lite-001", 1_000_000, 0, False),
        (2, "gemini-2.0-flash-001", 1_000_000, 1000, False),
        (3, "models/Gemini-2.5-Flash-Lite", 5000, 700, False),
        (4, "gemini-2.5-flash-preview", 5000, 700, True),
        (5, "unknown-model", 1_000_000, 1_000_000, False),
        (6, " text-embedding-004 ", 123456, 0, False),
        (7, "gemini-2.0-flash", 10, 10, True),
    ),
)

ANSWERS = Fixture(
    "answers",
    (("key", "int"), ("base", "double"), ("grounded", "boolean"), ("complete", "boolean"), ("citations", "int"), ("overlap", "double"), ("invalid", "int"), ("errors", "int")),
    (
        (1, 1.0, True, True, 8, 1.0, 0, 0),
        (2, 0.9, True, True, 1, 1.0, 0, 0),
        (3, 0.9, True, True, 1, 1.0, 3, 0),
        (4, 0.9, False, True, 2, 0.5, 0, 0),
        (5, 0.9, True, False, 2, 0.5, 1, 2),
        (6, 0.9, False, False, 0, 0.0, 0, 0),
        (7, None, None, None, 3, 1.0, 0, 0),
        (8, 0.0, True, True, 3, 1.0, 9, 1),
    ),
)

PULLS = Fixture(
    "pulls",
    (("key", "int"), ("ref", "string")),
    ((1, "owner/repo#12"), (2, "https://host.example/owner/repo/pull/7"), (3, "owner/repo"), (4, "https://host.example/owner/repo.git"), (5, "git@host.example:owner/repo.git"), (6, "what is this?")),
)


def _steps(word: str, indent: str) -> str:
    return "\n".join(f"{indent}{word}_{k} = prepare({k})" for k in range(10))


_STORE = f"""import os
from sys import path

def small(a):
    total = a + 1
    return total

@cached
class Store(Base):
    def get(self, key):
{_steps("got", "        ")}
    def put(self, key):
{_steps("put", "        ")}

VALUE_OF_THE_MODULE = small(1)
"""
_BOARD = f"""import {{ draw }} from "./draw";
// function hidden() {{ in a comment }}
export class Board extends Panel {{
  constructor(size) {{
    this.size = size; // "}}"
  }}
  async render(target, depth) {{
{_steps("const row", "    ")}
    if (depth > 0) {{ draw(target); }}
  }}
  get width() {{
{_steps("const col", "    ")}
  }}
}}

export default function openBoard(size) {{
  return new Board(size);
}}
interface Shape {{ name: string; sides: number }}
"""
_SERVER = """package server

import "fmt"

func (s *Server) Start(port int) error {
	return s.listen(port)
}

type Server struct {
	name string
	port int
}
"""
_TREE = """use std::fmt;

pub struct Tree<'a> {
    label: &'a str,
}

impl<'a> fmt::Display for Tree<'a> {
    fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result {
        write!(f, "{}", self.label)
    }
}

fn is_brace(c: char) -> bool { c == '{' }
"""
SOURCES = Fixture(
    "sources",
    (("path", "string"), ("content", "string")),
    (
        ("src/store.py", _STORE),
        ("web/board.ts", _BOARD),
        ("cmd/server.go", _SERVER),
        ("src/tree.rs", _TREE),
        ("src/broken.py", "def broken(:\n    return what_is_this\n"),
        ("notes.txt", "Only some words about nothing in particular.\n"),
        ("guide.md", "# Guide\nHow the store is opened and closed.\n"),
        ("empty.py", ""),
    ),
)
