"""Text as column expressions: code-aware tokens, hashes, previews, slugs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that no index holds.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "is", "it", "for", "on", "with", "as", "by", "at", "be", "this", "that", "from", "are", "was",
    "if", "else", "return", "self", "true", "false", "none", "null", "nil", "def", "var", "let", "const", "new", "import", "class", "function", "func",
    "public", "private", "static", "void", "int", "str", "string", "bool", "float", "list", "dict", "type", "value", "data",
)

CAMEL = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
DIGITS = "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
COMPOUND_WORD = "_|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
#: Tokens of a text where it is cut; it ends with the word that brings their number to this.
TOKENS = 4000


def _indexed(word: Column, least: int) -> Column:
    return (F.length(word) >= least) & ~word.isin(*STOPWORDS)


def word_tokens(word: Column, least: int = 2) -> Column:
    """What one word gives: itself in lower case, then, if it joins several names, their parts; stop words and short ones left out."""
    whole = F.filter(F.array(F.lower(word)), lambda t: _indexed(t, least))
    compound = (F.length(word) > 3) & (F.contains(word, F.lit("_")) | word.rlike("[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"))
    names = F.regexp_replace(F.replace(F.regexp_replace(word, CAMEL, " "), F.lit("_"), F.lit(" ")), DIGITS, " ")
    parts = F.filter(F.split(F.lower(names), " +"), lambda t: _indexed(t, least))
    return F.when(compound, F.concat(whole, parts)).otherwise(whole)


def word_terms(word: str) -> tuple[str, ...]:
    """word_tokens() of a word of ASCII letters, digits and '_', for tasks that have its text as Arrow."""
    found = [word.lower()]
    if len(word) > 3 and re.search(COMPOUND_WORD, word):
        found += re.sub(DIGITS, " ", re.sub(CAMEL, " ", word).replace("_", " ")).lower().split(" ")
    return tuple(t for t in found if len(t) >= 2 and t not in STOPWORDS)


#: A text without a match has no word of several names, and none that lower case would part elsewhere.
COMPOUND = "_|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[\u0130\u212A]"


def code_tokens(text: Column, least: int = 2, most: int | None = TOKENS) -> Column:
    """The tokens of a text in order, up to and with the word that brings their number to `most`, all of them without it; null for null.

    Everything happens inside the row, so no text is shuffled. A text without compound words, as most are, is lowered and split once and its
    words filtered; in the others each word gives its tokens and the cut is found by one fold over their counts.
    """
    plain = F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: _indexed(t, least))
    words = F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda w: w != "")
    each = F.transform(words, lambda w: word_tokens(w, least))
    if most is None:
        return F.when(text.isNotNull(), F.when(text.rlike(COMPOUND), F.flatten(each)).otherwise(plain))
    start = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("words"))
    step = lambda a, t: F.when(a["tokens"] >= most, a).otherwise(F.struct((a["tokens"] + F.size(t)).alias("tokens"), (a["words"] + 1).alias("words")))
    taken = F.aggregate(each, start, step, lambda a: a["words"])
    compound = F.flatten(F.slice(each, F.lit(1), taken))
    return F.when(text.isNotNull(), F.when(text.rlike(COMPOUND), compound).otherwise(F.slice(plain, 1, most)))


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    """16 hex digits of the SHA-1 of path, lines and the content's first 256 characters."""
    return F.substring(F.sha1(F.concat_ws(":", path, start.cast("string"), end.cast("string"), F.substring(content, 1, 256))), 1, 16)


def token_estimate(content: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(content) / 4)).cast("long")


def qualified_name(path: Column, parent: Column, symbol: Column) -> Column:
    """parent.symbol, the symbol alone, or the path where there is no symbol."""
    return F.when(symbol.isNotNull() & parent.isNotNull(), F.concat_ws(".", parent, symbol)).otherwise(F.coalesce(symbol, path))


def location(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def lexical_text(path: Column, qualified: Column, symbol: Column, content: Column) -> Column:
    """What is indexed of a chunk; empty parts are left out."""
    return F.concat_ws("\n", *(F.when(c != "", c) for c in (path, qualified, symbol, content)))


def embedding_text(path: Column, kind: Column, qualified: Column, content: Column, most: int = 8000) -> Column:
    return F.concat(path, F.lit(" | "), kind, F.lit(": "), qualified, F.lit("\n"), F.substring(content, 1, most))


def provenance(dense_rank: Column, lexical_rank: Column, rerank_score: Column) -> Column:
    """Where a result came from, ranks counted from 1."""
    parts = F.concat_ws(
        " + ",
        F.concat(F.lit("dense#"), (dense_rank + 1).cast("string")),
        F.concat(F.lit("bm25#"), (lexical_rank + 1).cast("string")),
        F.when(rerank_score.isNotNull(), F.format_string("rerank=%.2f", rerank_score)),
    )
    return F.when(parts == "", F.lit("unknown")).otherwise(parts)


def preview(content: Column, most: int = 150) -> Column:
    return F.substring(F.trim(F.regexp_replace(content, "\\s+", " ")), 1, most)


def slug(name: Column) -> Column:
    """Lower case, runs of other characters as one dash, no dash at either end."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def folder_slug(name: Column) -> Column:
    """A name as a folder's: letters and digits of any script, '.', '_' and '-' stay, runs of others become one dash; 'repo' if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^\\p{L}\\p{N}._-]+", "-"), "^-+|-+$", "")
    return F.when(kept == "", F.lit("repo")).otherwise(kept)


def keyword_coverage(answer: Column, terms: Column) -> Column:
    """Share of the terms that the answer contains, whatever their case; 1 without terms."""
    found = F.size(F.filter(terms, lambda t: F.contains(F.lower(answer), F.lower(t))))
    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(F.round(found / F.size(terms), 4))


def visitor_id(host: Column, forwarded: Column, agent: Column) -> Column:
    """20 hex digits for the first forwarded address, or else the host, with the agent."""
    first = F.trim(F.get(F.split(F.coalesce(forwarded, F.lit("")), ","), 0))
    address = F.coalesce(F.when(first != "", first), F.when(host != "", host), F.lit("unknown"))
    return F.substring(F.sha2(F.concat(address, F.lit("|"), F.substring(F.coalesce(agent, F.lit("")), 1, 120)), 256), 1, 20)


SCALAR = r'^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")$'


def balanced(text: Column, opener: str, closer: str) -> Column:
    """From the first opener to where its nesting closes, whatever strings and escapes hold; null if there is none or it stays open."""
    start = F.locate(opener, text)
    rest = F.substring(text, start, F.length(text))
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def step(s: Column, c: Column) -> Column:
        plain = ~s["escaped"] & (s["end"] == 0)
        code = plain & ~s["quoted"]
        depth = s["depth"] + F.when(code & (c == opener), 1).when(code & (c == closer), -1).otherwise(0)
        at = s["at"] + 1
        return F.struct(
            at.alias("at"),
            F.when(code & (c == closer) & (depth == 0), at).otherwise(s["end"]).alias("end"),
            depth.alias("depth"),
            F.when(plain & (c == '"'), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (plain & (c == "\\")).alias("escaped"),
        )

    end = F.aggregate(F.regexp_extract_all(rest, F.lit("(?s)."), F.lit(0)), state, step, lambda s: s["end"])
    return F.when((start > 0) & (end > 0), F.substring(rest, F.lit(1), end))


def whole_json(text: Column) -> Column:
    """The text, if it is one JSON value and nothing else; else null."""
    value = F.trim(F.regexp_replace(text, "^\\s+|\\s+$", ""))
    first = F.substring(value, 1, 1)
    nested = F.when(first == "{", balanced(value, "{", "}")).when(first == "[", balanced(value, "[", "]"))
    return F.when(first.isin("{", "["), F.when((nested == value) & F.try_parse_json(value).isNotNull(), value)).otherwise(F.when(value.rlike(SCALAR), value))


def json_value(text: Column) -> Column:
    """The first JSON in a model's reply: the whole of it, or what the first fence holds, or the first object whose braces balance, or the first such list; else null."""
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(whole_json(text), whole_json(fenced), valid(balanced(text, "{", "}")), valid(balanced(text, "[", "]")))


def stable_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object of the fields in the order of their names."""
    return F.sha2(F.to_json(F.struct(*(fields[n].alias(n) for n in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def rendered(path: Column, start: Column, end: Column, symbol: Column, content: Column) -> Column:
    """A chunk as a prompt shows it: its place, its symbol if it has one, its text."""
    return F.concat(F.lit("### "), location(path, start, end), F.when(symbol.isNotNull(), F.concat(F.lit(" ("), symbol, F.lit(")"))).otherwise(""), F.lit("\n"), content)


def cache_key(model: Column, task: Column, dims: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit("emb"), model, task, dims.cast("string"), F.sha2(text, 256))
