"""What a source file declares: Python by its own parser, languages with braces by a scan of their brackets; one file failing fails no other."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of a file's header, of an outline and of a name.
IMPORTS = 12
IMPORT_CHARS = 200
HEADER_CHARS = 600
OUTLINED = 60
NAME_CHARS = 120

#: first and last line from 0; parent: the container of a member; outline: a container's own text in place of its lines.
OUTLINE = "struct<imports array<string>, found array<struct<first int, last int, kind string, symbol string, parent string, outline string, top boolean>>>"
_FOUND = [("first", pa.int32()), ("last", pa.int32()), ("kind", pa.string()), ("symbol", pa.string()), ("parent", pa.string()), ("outline", pa.string()), ("top", pa.bool_())]
OUTLINE_ARROW = pa.struct([("imports", pa.list_(pa.string())), ("found", pa.list_(pa.struct(_FOUND)))])
#: Files, and bytes of their texts, whose outlines are Python objects at once.
ROWS = 256
BYTES = 1 << 20


@dataclass
class Declaration:
    first: int
    last: int
    kind: str
    symbol: str | None
    container: bool = False
    members: list[Declaration] = field(default_factory=list)


# Python


def _python_members(node: ast.AST) -> list[Declaration]:
    """Functions of a class, and classes with theirs."""
    own = [n for n in getattr(node, "body", []) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    return [Declaration(n.lineno - 1, n.end_lineno - 1, "class", n.name, True, _python_members(n)) if isinstance(n, ast.ClassDef) else Declaration(n.lineno - 1, n.end_lineno - 1, "function", n.name) for n in own]


def python_outline(text: str) -> tuple[list[str], list[Declaration]]:
    """Imports and top-level declarations; what decorates one isn't part of it."""
    found, imports = [], []
    for n in ast.parse(text).body:
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            imports.append(ast.get_source_segment(text, n) or "")
        elif isinstance(n, ast.ClassDef):
            found.append(Declaration(n.lineno - 1, n.end_lineno - 1, "class", n.name, True, _python_members(n)))
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            found.append(Declaration(n.lineno - 1, n.end_lineno - 1, "function", n.name))
    return imports, found


# Languages with braces

_NAME = r"([A-Za-z_$][\w$]*)"
_OPEN_JS = r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?"
_ACCESS = r"^(?:(?:@\w+(?:\([^()]*\))?|public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|readonly|unsafe|synchronized|default|open|data|inline|suspend)\s+)*"


@dataclass(frozen=True)
class Grammar:
    """heads: (pattern of what stands before a brace or semicolon, kind, whether it holds members), the first that matches decides."""

    imports: str
    heads: tuple[tuple[str, str, bool], ...]
    member: str = ""
    single_quotes: bool = False
    #: Whether a line's end can end a statement.
    line_ends: bool = False


_JS = Grammar(
    r"^import\b",
    (
        (_OPEN_JS + r"(?:abstract\s+)?class\s+" + _NAME, "class", True),
        (_OPEN_JS + r"(?:async\s+)?function\s*\*?\s*" + _NAME, "function", False),
        (_OPEN_JS + r"(?:interface|enum|type)\s+" + _NAME, "interface", False),
        (_OPEN_JS + r"(?:const\s+enum)\s+" + _NAME, "interface", False),
        (_OPEN_JS + r"(?:const|let|var)\s+" + _NAME, "block", False),
    ),
    r"^(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+|\*\s*)*#?" + _NAME + r"\s*(?:<[^<>]*>)?\s*\(",
    True,
    True,
)
_JAVA = Grammar(
    r"^import\b",
    (
        (_ACCESS + r"class\s+" + _NAME, "class", True),
        (_ACCESS + r"(?:struct|record)\s+(?:class\s+|struct\s+)?" + _NAME, "class", False),
        (_ACCESS + r"(?:@?interface|enum)\s+" + _NAME, "interface", False),
        (_ACCESS + r"[\w<>\[\],.?]+\s+" + _NAME + r"\s*\(", "method", False),
    ),
    _ACCESS + r"(?:<[^<>]*>\s*)?(?:[\w<>\[\],.?]+\s+)?" + _NAME + r"\s*\(",
)
GRAMMARS: dict[str, Grammar] = {
    "javascript": _JS,
    "typescript": _JS,
    "tsx": _JS,
    "java": _JAVA,
    "csharp": Grammar(r"^using\b", _JAVA.heads, _JAVA.member),
    "kotlin": Grammar(r"^import\b", ((_ACCESS + r"(?:class|object)\s+" + _NAME, "class", False), (_ACCESS + r"fun\s+(?:<[^<>]*>\s*)?(?:\w+\.)?" + _NAME, "function", False)), line_ends=True),
    "go": Grammar(
        r"^import\b",
        ((r"^func\s+\([^()]*\)\s*" + _NAME, "method", False), (r"^func\s+" + _NAME, "function", False), (r"^type\s+" + _NAME, "interface", False), (r"^const\s+" + _NAME + "?", "block", False)),
        line_ends=True,
    ),
    "rust": Grammar(
        r"^(?:pub\s+)?use\b",
        (
            (r"^(?:pub(?:\([^()]*\))?\s+)?impl\b(?:\s*<[^{}]*?>)?\s+(?:[\w:<>, ]+?\s+for\s+)?" + _NAME, "class", True),
            (r"^(?:pub(?:\([^()]*\))?\s+)?struct\s+" + _NAME, "class", False),
            (r"^(?:pub(?:\([^()]*\))?\s+)?(?:unsafe\s+)?(?:trait|enum)\s+" + _NAME, "interface", False),
            (r"^(?:pub(?:\([^()]*\))?\s+)?mod\s+" + _NAME, "module", False),
            (r"^(?:pub(?:\([^()]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\S+)?)\s+)*fn\s+" + _NAME, "function", False),
        ),
        r"^(?:pub(?:\([^()]*\))?\s+)?(?:(?:const|async|unsafe)\s+)*fn\s+" + _NAME,
    ),
    "c": Grammar(r"^#\s*include\b", ((r"^(?:typedef\s+)?(?:struct|union)\s+" + _NAME, "class", False), (r"^(?:typedef\s+)?enum\s+" + _NAME, "interface", False), (r"^[\w\s*]+?[\s*]" + _NAME + r"\s*\(", "function", False))),
    "cpp": Grammar(
        r"^#\s*include\b",
        (
            (r"^(?:template\s*<[^{}]*?>\s*)?class\s+" + _NAME, "class", True),
            (r"^(?:template\s*<[^{}]*?>\s*)?struct\s+" + _NAME, "class", False),
            (r"^(?:inline\s+)?namespace\s+" + _NAME, "module", False),
            (r"^(?:template\s*<[^{}]*?>\s*)?[\w\s:*&<>,]+?[\s*&:]" + r"(~?[A-Za-z_]\w*)" + r"\s*\(", "function", False),
        ),
        r"^(?:(?:static|virtual|inline|explicit|constexpr)\s+)*(?:[\w\s:*&<>,]+?[\s*&])?" + r"(~?[A-Za-z_]\w*)" + r"\s*\(",
    ),
    "php": Grammar(
        r"^use\b",
        ((r"^(?:(?:abstract|final|readonly)\s+)*class\s+" + _NAME, "class", True), (r"^(?:interface|trait)\s+" + _NAME, "interface", False), (r"^function\s+&?" + _NAME, "function", False)),
        r"^(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?" + _NAME,
        True,
    ),
}

_NOT_CODE = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\""
_SINGLE = re.compile(_NOT_CODE + r"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_CHARACTER = re.compile(_NOT_CODE + r"|'(?:\\[^\n]{1,8}?|[^'\\\n])'|`[^`]*`", re.S)
#: Brackets, ends of statements, and a line's end with what the next one is indented by.
_MARKS = re.compile(r"[{}()\[\];]|\n[^\S\n]*")
#: Characters of a statement that its head is looked for in.
HEAD_CHARS = 600
#: What a line ends, or the next begins, with if a statement goes on.
_GOES_ON_AFTER = frozenset("=,+-*/%&|?:.<([{!~^")
_GOES_ON_WITH = frozenset(".?:+*/%&|,)]}{=<>")
#: What a statement is that has no braces of its own.
_NEEDS_BRACES = ("function", "method")
_WORDS_BEFORE_PARENTHESES = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "foreach"}


def bare(text: str, single_quotes: bool) -> str:
    """The text with comments and literals blanked, all else in its place."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return (_SINGLE if single_quotes else _CHARACTER).sub(blank, text)


def _first_code(code: str, begin: int) -> int:
    """Where a statement begins: after white space and, at its start, lines of preprocessor marks and attributes."""
    while True:
        at = re.compile(r"\s*").match(code, begin).end()
        skipped = re.compile(r"(?:#[^\n]*|@\w+(?:\([^()]*\))?)(?=\s)").match(code, at)
        if not skipped:
            return at
        begin = skipped.end()


@dataclass
class _Scope:
    """A file, or what a container's braces hold: its statement so far and the declarations before it."""

    inner: bool
    found: list[Declaration] = field(default_factory=list)
    begin: int = -1
    tried: bool = False
    head: tuple[int, str, str | None, bool] | None = None
    brace: bool = False
    depth: int = 0
    parens: int = 0
    square: int = 0

    def over(self) -> None:
        self.begin, self.tried, self.head, self.brace, self.parens, self.square = -1, False, None, False, 0, 0


class _Scan:
    """One pass over the brackets, statement ends and line ends of a file, with a stack of the containers that are open.

    What a statement declares is told from its first HEAD_CHARS characters, once: at its brace or its end, or where lines end statements at the
    start of each line that can begin one. So the work is linear in the file's length, however long a statement is.
    """

    def __init__(self, code: str, grammar: Grammar):
        self.code, self.grammar = code, grammar
        self.ends = [m.start() for m in re.finditer("\n", code)]
        self.scopes = [_Scope(False)]
        self.last = -1

    def row(self, at: int) -> int:
        return bisect_left(self.ends, at)

    def head(self, at: int, stop: int, inner: bool) -> tuple[int, str, str | None, bool] | None:
        """Where a declaration begins, its kind, its name and whether it holds members."""
        at = _first_code(self.code, at)
        text = re.sub(r"\s+", " ", self.code[at : min(stop, at + HEAD_CHARS)])
        if not text:
            return None
        for pattern, kind, holds in self.grammar.heads:
            if inner and kind not in ("class", "interface"):
                continue
            m = re.match(pattern, text)
            if m and (m[1] or "") not in _WORDS_BEFORE_PARENTHESES:
                return at, kind, (m[1] or None) and m[1][:NAME_CHARS], holds
        m = re.match(self.grammar.member, text) if inner and self.grammar.member else None
        return (at, "method", m[1][:NAME_CHARS], False) if m and m[1] not in _WORDS_BEFORE_PARENTHESES else None

    def told(self, scope: _Scope, stop: int) -> None:
        if scope.head is None and not scope.tried and scope.begin >= 0:
            scope.head, scope.tried = self.head(scope.begin, stop, scope.inner), True

    def done(self, scope: _Scope, end: int, members: list[Declaration] | None = None) -> None:
        """The statement ends before `end`."""
        if scope.head is not None and (scope.brace or scope.head[1] not in _NEEDS_BRACES):
            at, kind, name, holds = scope.head
            scope.found.append(Declaration(self.row(at), self.row(end - 1), kind, name, holds, members or []))
        scope.over()

    def line(self, scope: _Scope, nxt: int, before: str) -> None:
        """A line's end between statements, or inside one, where lines may end them."""
        code = self.code
        fresh = self.head(nxt, len(code), scope.inner) if (not scope.parens and not scope.square) or code[nxt - 1] == "\n" else None
        if fresh is not None and not (scope.begin >= 0 and before in _GOES_ON_AFTER and scope.parens + scope.square == 0):
            if not scope.brace:
                self.told(scope, self.last + 1)
                self.done(scope, self.last + 1)
            scope.over()
            scope.begin, scope.head, scope.tried = nxt, fresh, True
        elif not scope.parens and not scope.square and not scope.brace and before not in _GOES_ON_AFTER and code[nxt] not in _GOES_ON_WITH:
            self.told(scope, self.last + 1)
            kind = scope.head[1] if scope.head else "block"
            if kind == "block" or (kind == "interface" and "=" in code[scope.begin : min(self.last + 1, scope.begin + HEAD_CHARS)]):
                self.done(scope, self.last + 1)
                scope.begin = nxt

    def run(self) -> list[Declaration]:
        code, at, before = self.code, 0, "\n"
        for m in _MARKS.finditer(code):
            mark, scope, own = m[0], self.scopes[-1], code[at : m.start()]
            stripped = own.rstrip()
            if stripped.strip():
                if scope.begin < 0:
                    scope.begin = at + len(own) - len(own.lstrip())
                before, self.last = stripped[-1], at + len(stripped) - 1
            at = m.end()
            if mark[0] == "\n":
                if self.grammar.line_ends and not scope.depth and at < len(code) and code[at] != "\n":
                    self.line(scope, at, before)
                continue
            before, self.last = mark, m.start()
            if mark in "([":
                if scope.begin < 0:
                    scope.begin = m.start()
                if not scope.depth:
                    scope.parens, scope.square = scope.parens + (mark == "("), scope.square + (mark == "[")
            elif mark in ")]":
                if not scope.depth:
                    scope.parens, scope.square = max(0, scope.parens - (mark == ")")), max(0, scope.square - (mark == "]"))
            elif mark == "{":
                if not scope.depth and not scope.parens:
                    self.told(scope, m.start())
                    first, scope.brace = not scope.brace, True
                    if first and scope.head is not None and scope.head[3] and self.grammar.member:
                        self.scopes.append(_Scope(True))
                        continue
                scope.depth += 1
            elif mark == "}":
                if not scope.depth and scope.inner:
                    self.scopes.pop()
                    self.done(self.scopes[-1], at, scope.found)
                    continue
                scope.depth = max(0, scope.depth - 1)
                if not scope.depth and not scope.parens and scope.brace:
                    self.done(scope, at)
            elif not scope.depth and not scope.parens:
                self.told(scope, m.start())
                self.done(scope, at)
        if self.grammar.line_ends and len(self.scopes) == 1 and not self.scopes[0].depth:
            if code[at:].strip():
                self.last = len(code.rstrip()) - 1
                if self.scopes[0].begin < 0:
                    self.scopes[0].begin = at
            self.told(self.scopes[0], len(code))
            if not self.scopes[0].brace:
                self.done(self.scopes[0], self.last + 1)
        return self.scopes[0].found


def brace_outline(text: str, grammar: Grammar) -> tuple[list[str], list[Declaration]]:
    code = bare(text, grammar.single_quotes)
    imports = [m[0] for m in re.finditer(r"^[^\n]+", text, re.M) if re.match(grammar.imports, m[0]) and code[m.start() : m.start() + 1].strip()]
    return imports, _Scan(code, grammar).run()


def _listed(found: list[Declaration], lines: list[str], max_lines: int, parent: str | None = None) -> list[dict]:
    """A row for each declaration; a container of more than max_lines as its outline, then its members, and so on inside of them."""
    out = []
    for d in found:
        members = [m for m in d.members if m.last > m.first]
        outline = None
        if d.last - d.first + 1 > max_lines and d.container and members:
            shown = [f"    {lines[m.first].strip()}" for m in members[:OUTLINED]]
            more = [f"    # ... and {len(members) - OUTLINED} more members"] if len(members) > OUTLINED else []
            outline = "\n".join([f"# Outline of {d.symbol or 'container'} ({len(members)} members)", lines[d.first].strip(), *shown, *more, ""])
        out.append({"first": d.first, "last": d.last, "kind": d.kind, "symbol": d.symbol, "parent": parent, "outline": outline, "top": parent is None})
        if outline is not None:
            out += _listed(members, lines, max_lines, d.symbol or "container")
    return out


def outline_of(text: str | None, language: str | None, max_lines: int) -> dict | None:
    """imports and found (see OUTLINE); null where the language has no grammar here, or the text doesn't parse."""
    try:
        if not text or language not in ("python", *GRAMMARS):
            return None
        imports, found = python_outline(text) if language == "python" else brace_outline(text, GRAMMARS[language])
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    try:
        out = _listed(found, text.split("\n"), max_lines)
    except RecursionError:
        return None
    kept = [i.strip() for i in imports if i.strip() and len(i.strip()) < IMPORT_CHARS][:IMPORTS]
    return {"imports": kept, "found": out}


def outlines(texts: pa.Array, languages: pa.Array, max_lines: int) -> Iterator[pa.Array]:
    """outline_of() each file, as arrays of ROWS files at most, and of more than BYTES of text only if it is one file's."""
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
    a = 0
    while a < len(texts):
        b = min(a + ROWS, len(texts), max(a + 1, int(np.searchsorted(upto, upto[a] + BYTES, "right")) - 1))
        rows = zip(texts.slice(a, b - a).to_pylist(), languages.slice(a, b - a).to_pylist())
        yield pa.array([outline_of(t, name, max_lines) or {"imports": None, "found": None} for t, name in rows], OUTLINE_ARROW)
        a = b


def outline(text: Column, language: Column, max_lines: int) -> Column:
    """OUTLINE of each file, in Arrow batches: a task holds Python objects of a few files at once."""

    @F.arrow_udf(OUTLINE)
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], OUTLINE_ARROW), *outlines(texts, languages, max_lines)])

    return run(text, language)
