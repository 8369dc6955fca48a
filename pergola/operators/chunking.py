"""Files into overlapping chunks: windows of lines, sections, the islands that declarations leave. All inside the row: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergola.functions import declarations
from pergola.functions.paths import language
from pergola.functions.text import chunk_id

MAX_LINES = 120
OVERLAP = 15
LEAST_CHARS = 24
MERGE_GAP = 4
HEADING = "^#{1,4}\\s+.*$"


def lines_of(text: Column) -> Column:
    """The lines of a text, a last empty one left out; none for null and ''."""
    body = F.regexp_replace(text, "\\n$", "")
    return F.when((text == "") | text.isNull(), F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def limits(max_lines: int, overlap: int) -> tuple[int, int]:
    """A window has 20 lines at least; an overlap is at most half of it."""
    most = max(20, max_lines)
    return most, max(0, min(overlap, most // 2))


def _blank(line: Column) -> Column:
    return ~line.rlike("\\S")


def snapped(lines: Column, start: Column, stop: Column, end: Column, most: int, overlap: int, compat: bool) -> Column:
    """Where a window that would stop at `stop` does: at the nearest blank line up to 12 before, or before the nearest line that isn't indented.

    compat follows the older rule, by which the last line of a file and lines between windows can be lost; without it a window that reaches
    the end is not moved, and none is moved back further than the next one's start.
    """
    low = F.greatest(start + 5, stop - 12)
    places = F.when(stop > low, F.reverse(F.sequence(low + 1, stop)))
    found = F.get(F.filter(places, lambda i: _blank(F.get(lines, i)) | F.get(lines, i).rlike("^\\S")), 0)
    moved = F.when(found.isNull(), stop).when(_blank(F.get(lines, found)), found).otherwise(F.greatest(start, found - 1))
    if compat:
        return moved
    return F.when((stop >= end) | (moved < start + max(1, most - overlap) - 1), stop).otherwise(moved)


def windows(lines: Column, start: Column, end: Column, max_lines: int = MAX_LINES, overlap: int = OVERLAP, compat: bool = False) -> Column:
    """Array of structs first, last (from 0) that cover start to end.

    A window's start never depends on where the one before was moved to, as it stops within its own lines; so starts are a plain sequence
    and only where the sequence ends is asked of the stops.
    """
    most, over = limits(max_lines, overlap)
    step = max(1, most - over)
    found = F.transform(F.sequence(start, end, F.lit(step)), lambda s: F.struct(s.alias("first"), snapped(lines, s, F.least(s + most - 1, end), end, most, over, compat).alias("last")))
    reached = F.array_position(F.transform(found, lambda w: w["last"] >= end), F.lit(True))
    cut = F.when(reached == 0, found).otherwise(F.slice(found, F.lit(1), reached.cast("int")))
    one = F.array(F.struct(start.alias("first"), end.alias("last")))
    return F.when(end < start, F.array().cast("array<struct<first:int,last:int>>")).when(end - start + 1 <= most, one).otherwise(cut)


def sections(lines: Column) -> Column:
    """Array of structs title, first, last: from each heading to the next; 'preamble' before the first; a text without headings whole, without a title."""
    n = F.size(lines)
    places = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(lines, i).rlike(HEADING))).otherwise(F.array().cast("array<int>"))
    following = F.concat(F.slice(places, F.lit(2), F.size(places)), F.array(n))
    own = F.zip_with(
        places,
        following,
        lambda at, after: F.struct(F.trim(F.regexp_extract(F.get(lines, at), "^#{1,4}\\s+(.*)$", 1)).alias("title"), at.alias("first"), (after - 1).alias("last")),
    )
    first = F.get(places, 0)
    before = F.array(F.struct(F.lit("preamble").alias("title"), F.lit(0).alias("first"), (first - 1).alias("last")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.lit(0).alias("first"), (n - 1).alias("last")))
    return F.when(n == 0, F.slice(whole, 1, 0)).when(F.size(places) == 0, whole).when(first > 0, F.concat(before, own)).otherwise(own)


def islands(lines: Column, covered: Column, gap: int = MERGE_GAP) -> Column:
    """Array of structs first, last: runs of lines with text that `covered` (array of numbers from 0) leaves, runs closer than `gap` as one."""
    n = F.size(lines)
    free = F.array_except(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), covered)
    own = F.filter(free, lambda i: ~_blank(F.get(lines, i)))
    # neighbours are zipped with, for an array that a lambda looks into would be computed for each of its elements
    none = F.array(F.lit(None).cast("int"))
    edges = lambda beside, far: F.transform(F.filter(F.zip_with(own, beside, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & (p["y"].isNull() | far(p["x"], p["y"]))), lambda p: p["x"])
    starts = edges(F.concat(none, own), lambda x, before: x - before > gap)
    ends = edges(F.concat(F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(0))), none), lambda x, after: after - x > gap)
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def _rows(spans: DataFrame, header: Column, kind: str) -> DataFrame:
    body = F.array_join(F.slice("lines", F.col("span.first") + 1, F.col("span.last") - F.col("span.first") + 1), "\n")
    content = F.concat(header, body)
    rows = spans.select(
        "path",
        content.alias("content"),
        (F.col("span.first") + 1).alias("start_line"),
        (F.col("span.last") + 1).alias("end_line"),
        F.col("language"),
        F.lit(kind).alias("kind"),
        F.col("symbol"),
        F.length(F.trim(F.regexp_replace(body, "^\\s+|\\s+$", ""))).alias("body_chars"),
    )
    return rows.where(F.col("body_chars") >= LEAST_CHARS).drop("body_chars").withColumn("chunk_id", chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content")))


def line_chunks(files: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP, compat: bool = False) -> DataFrame:
    """Chunks of path, content rows as windows of lines, each under a line that names its file."""
    lined = files.select("path", language(F.col("path")).alias("language"), lines_of(F.col("content")).alias("lines"))
    spans = lined.select("path", "language", "lines", F.lit(None).cast("string").alias("symbol"), F.explode(windows(F.col("lines"), F.lit(0), F.size("lines") - 1, max_lines, overlap, compat)).alias("span"))
    return _rows(spans, F.concat(F.lit("// file: "), F.col("path"), F.lit(" ("), F.col("language"), F.lit(")\n")), "block")


def section_chunks(files: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP, compat: bool = False) -> DataFrame:
    """Chunks of path, content rows of documentation: windows of each section, named after it."""
    lined = files.select("path", language(F.col("path")).alias("language"), lines_of(F.col("content")).alias("lines"))
    parts = lined.select("path", "language", "lines", F.explode(sections(F.col("lines"))).alias("part"))
    spans = parts.select("path", "language", "lines", F.col("part.title").alias("symbol"), F.explode(windows(F.col("lines"), F.col("part.first"), F.col("part.last"), max_lines, overlap, compat)).alias("span"))
    return _rows(spans, F.concat(F.lit("// file: "), F.col("path"), F.lit(" (documentation)\n")), "documentation")


def _windowed(lines: Column, first: Column, last: Column, kind: Column, symbol: Column, max_lines: int, overlap: int) -> Column:
    """The windows of some lines as spans of one kind and symbol."""
    none = F.lit(None).cast("string")
    return F.transform(windows(lines, first, last, max_lines, overlap), lambda w: F.struct(w["first"].alias("first"), w["last"].alias("last"), kind.alias("kind"), symbol.alias("symbol"), none.alias("parent"), none.alias("outline")))


def parsed(files: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """path, language, lines and outline (see functions.declarations) of path, content rows; outlines are null for other languages and files that don't parse."""
    named = files.select("path", "content", language(F.col("path")).alias("language"))
    return named.select("path", "language", lines_of(F.col("content")).alias("lines"), declarations.outline(F.col("content"), F.col("language"), max(20, max_lines)).alias("outline"))


def code_spans(rows: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """parsed() rows with spans: each declaration, a container of more than max_lines as its outline and its members, any other of more than twice
    that in windows; then windows of what they leave. Files without declarations are windows of lines."""
    most, over = limits(max_lines, overlap)
    found = F.col("outline.found")
    none = F.lit(None).cast("string")
    one = lambda d: F.array(F.struct(d["first"].alias("first"), d["last"].alias("last"), d["kind"].alias("kind"), d["symbol"].alias("symbol"), d["parent"].alias("parent"), d["outline"].alias("outline")))
    size = lambda d: d["last"] - d["first"] + 1
    long = lambda d: d["top"] & d["outline"].isNull() & (size(d) > 2 * most)
    own = F.flatten(F.transform(found, lambda d: F.when(long(d), _windowed(F.col("lines"), d["first"], d["last"], d["kind"], d["symbol"], most, over)).otherwise(one(d))))
    covered = F.array_distinct(F.flatten(F.transform(F.filter(found, lambda d: d["top"]), lambda d: F.sequence(d["first"], d["last"]))))
    rest = F.flatten(F.transform(islands(F.col("lines"), covered), lambda i: _windowed(F.col("lines"), i["first"], i["last"], F.lit("module"), none, most, over)))
    plain = _windowed(F.col("lines"), F.lit(0), F.size("lines") - 1, F.lit("block"), none, most, over)
    return rows.withColumn("declared", F.coalesce(F.size(found) > 0, F.lit(False))).withColumn("spans", F.when(F.col("declared"), F.concat(own, rest)).otherwise(plain))


def code_chunks(files: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of path, content rows of code by what they declare, each under the file's name and its first imports; parent_symbol: a member's container."""
    # an outer explosion, as the planner would compute the spans once more to leave out files without any
    rows = code_spans(parsed(files, max_lines), max_lines, overlap).select("path", "language", "lines", "declared", "outline.imports", F.explode_outer("spans").alias("span")).where("span IS NOT NULL")
    imports = F.concat(F.lit("// imports: "), F.substring(F.replace(F.array_join("imports", "; "), F.lit("\n"), F.lit(" ")), 1, declarations.HEADER_CHARS), F.lit("\n"))
    header = F.concat(F.lit("// file: "), "path", F.lit(" ("), "language", F.lit(")\n"), F.when(F.col("declared") & (F.size("imports") > 0), imports).otherwise(""))
    body = F.coalesce("span.outline", F.array_join(F.slice("lines", F.col("span.first") + 1, F.col("span.last") - F.col("span.first") + 1), "\n"))
    found = rows.select(
        "path",
        F.concat(header, body).alias("content"),
        (F.col("span.first") + 1).alias("start_line"),
        (F.col("span.last") + 1).alias("end_line"),
        "language",
        F.col("span.kind").alias("kind"),
        F.col("span.symbol").alias("symbol"),
        F.col("span.parent").alias("parent_symbol"),
        F.length(F.regexp_replace(body, "^\\s+|\\s+$", "")).alias("body_chars"),
    )
    return found.where(F.col("body_chars") >= LEAST_CHARS).drop("body_chars").withColumn("chunk_id", chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content")))


def code_stats(rows: DataFrame) -> DataFrame:
    """files, declared, fallback, skeletons, coverage (share of declared) over code_spans() rows."""
    n = F.count("*")
    return rows.agg(
        n.alias("files"),
        F.count_if("declared").alias("declared"),
        F.count_if(~F.col("declared")).alias("fallback"),
        F.coalesce(F.sum(F.size(F.filter("spans", lambda s: s["outline"].isNotNull()))), F.lit(0)).cast("long").alias("skeletons"),
        F.round(F.coalesce(F.count_if("declared") / F.nullif(n, F.lit(0)), F.lit(0.0)), 4).alias("coverage"),
    )


def chunks(files: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP, compat: bool = False) -> DataFrame:
    """Documentation by sections, all else by declarations, or by lines where there are none; with compat all by lines."""
    doc = language(F.col("path")).isin("markdown", "rst")
    if compat:
        return section_chunks(files.where(doc), max_lines, overlap, True).unionByName(line_chunks(files.where(~doc), max_lines, overlap, True))
    parts = section_chunks(files.where(doc), max_lines, overlap).withColumn("parent_symbol", F.lit(None).cast("string"))
    return parts.unionByName(code_chunks(files.where(~doc), max_lines, overlap))


def last_by_id(rows: DataFrame) -> DataFrame:
    """Of chunks with equal ids the last by file and line."""
    return rows.groupBy("chunk_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "chunk_id")), F.struct("path", "start_line", "end_line")).alias("r")).select("chunk_id", "r.*")


PER_DIRECTORY = 14
IN_MAP = 260


def map_directories(files: DataFrame, per_directory: int = PER_DIRECTORY, most: int = IN_MAP) -> DataFrame:
    """dir, lines, files, shown, more: directories by falling lines, as many as a map of `most` files has room for."""
    from pyspark.sql import Window

    directory = F.regexp_replace("path", "/[^/]*$", "")
    rows = files.select(F.when(F.contains("path", F.lit("/")), directory).otherwise("(root)").alias("dir"), F.size(lines_of(F.col("content"))).alias("n"))
    totals = rows.groupBy("dir").agg(F.sum("n").alias("lines"), F.count("*").alias("files"))
    # a directory shows one file at least, so no more than `most` of them matter: the cut comes before the one-task window
    first = totals.orderBy(F.desc("lines"), "dir").limit(most)
    before = Window.orderBy(F.desc("lines"), "dir").rowsBetween(Window.unboundedPreceding, -1)
    placed = first.withColumn("before", F.coalesce(F.sum(F.least("files", F.lit(per_directory))).over(before), F.lit(0))).where(F.col("before") < most)
    return placed.select("dir", "lines", "files", F.least("files", F.lit(per_directory), most - F.col("before")).alias("shown"), F.greatest(F.col("files") - per_directory, F.lit(0)).alias("more"))


def repo_map(files: DataFrame, chunks: DataFrame, per_directory: int = PER_DIRECTORY, symbols: int = 6) -> DataFrame:
    """One row, map: directories of map_directories() with their largest files and the first symbols of each. chunks: path, symbol, kind, start_line."""
    from pyspark.sql import Window

    dirs = map_directories(files, per_directory)
    directory = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("(root)")
    named = chunks.where(F.col("symbol").isNotNull() & F.col("kind").isin("class", "function", "interface", "module"))
    first = named.groupBy("path", "symbol").agg(F.min("start_line").alias("at"))
    listed = first.groupBy("path").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), 1, symbols).alias("names"))
    rows = files.select("path", directory.alias("dir"), F.size(lines_of(F.col("content"))).alias("n")).join(F.broadcast(dirs), "dir")
    place = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("n"), "path"))
    rows = rows.withColumn("place", place).where(F.col("place") <= F.col("shown")).join(listed, "path", "left")
    suffix = F.when(F.size("names") > 0, F.concat(F.lit("  -> "), F.array_join("names", ", "))).otherwise("")
    line = F.concat(F.lit("  "), F.substring_index("path", "/", -1), F.lit(" ("), F.col("n").cast("string"), F.lit(" lines)"), suffix)
    blocks = rows.groupBy("dir", "lines", "more").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("text")))), lambda x: x["text"]), "\n").alias("body"))
    block = F.concat("dir", F.lit("/\n"), "body", F.when(F.col("more") > 0, F.concat(F.lit("\n  ... "), F.col("more").cast("string"), F.lit(" more files"))).otherwise(""), F.lit("\n"))
    whole = blocks.agg(F.sort_array(F.collect_list(F.struct((-F.col("lines")).alias("o"), "dir", block.alias("text")))).alias("all"))
    totals = files.agg(F.count("*").alias("files"), F.sum(F.size(lines_of(F.col("content")))).alias("total")).crossJoin(chunks.agg(F.count("*").alias("chunks")))
    head = F.format_string("REPOSITORY MAP  |  %d files, %s lines, %d indexed chunks\n\n", "files", F.format_number("total", 0), "chunks")
    return whole.crossJoin(totals).select(F.concat(head, F.array_join(F.transform("all", lambda x: x["text"]), "\n")).alias("map"))
