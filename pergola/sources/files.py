"""Files of a repository as rows, with why others are left out; evaluation cases; diffs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pergola.functions import paths
from pergola.sources import repository as reader

CASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("expected_paths", T.ArrayType(T.StringType())),
        T.StructField("expected_symbols", T.ArrayType(T.StringType())),
        T.StructField("must_mention", T.ArrayType(T.StringType())),
        T.StructField("reference_answer", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("difficulty", T.StringType()),
    ]
)


# The named classes of a glob, in Java's terms.
NAMED = {"alnum": "\\p{Alnum}", "alpha": "\\p{Alpha}", "digit": "0-9", "lower": "a-z", "upper": "A-Z", "space": "\\s", "punct": "\\p{Punct}", "xdigit": "0-9A-Fa-f"}


def _literal(c: str) -> str:
    return "\\" + c if c in ".^$+{}()|[]\\*?-&~#" else c


def _bracket(glob: str, i: int) -> tuple[str, int] | None:
    """The class that opens at i as a regular expression, and the place after it; None if it doesn't close."""
    j = i + 1
    negated = j < len(glob) and glob[j] in "!^"
    j += negated
    out, first = "", True
    while j < len(glob) and (glob[j] != "]" or first):
        named = re.match(r"\[:([a-z]+):\]", glob[j:])
        if named and named[1] in NAMED:
            out, j = out + NAMED[named[1]], j + len(named[0])
        elif glob[j] == "\\" and j + 1 < len(glob):
            out, j = out + _literal(glob[j + 1]), j + 2
        elif glob[j] == "-" and not first and j + 1 < len(glob) and glob[j + 1] != "]":
            out, j = out + "-", j + 1
        else:
            out, j = out + _literal(glob[j]), j + 1
        first = False
    return None if j >= len(glob) else (f"(?!/)[{'^' if negated else ''}{out}]", j + 1)


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ** between slashes or at an end crosses slashes; *, ? and classes don't; a backslash takes the next as it is."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        before, bracket = i == 0 or glob[i - 1] == "/", _bracket(glob, i) if c == "[" else None
        if before and glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif before and glob[i:] == "**":
            out, i = out + ".*", i + 2
        elif bracket:
            out, i = out + bracket[0], bracket[1]
        elif c == "*":
            out, i = out + "[^/]*", i + len(glob[i:]) - len(glob[i:].lstrip("*"))
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + _literal(glob[i + 1]), i + 2
        else:
            out, i = out + ("[^/]" if c == "?" else _literal(c)), i + 1
    return out


def ignore_rules(lines: list[str]) -> list[tuple[str, bool, bool]]:
    """(regular expression, whether for folders alone, whether it takes back) of an ignore file's lines, in order.

    Blank lines and comments are none; a backslash keeps '#', '!' and a space at the end; a slash before the end ties a rule to the root.
    """
    rules = []
    for line in lines:
        rule = line.rstrip("\r\n")
        bare = rule.rstrip(" ")
        rule = bare + " " if bare.endswith("\\") and len(rule) > len(bare) and (len(bare) - len(bare.rstrip("\\"))) % 2 else bare
        if not rule.strip() or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.removeprefix("!")
        only_dir = rule.endswith("/")
        rule = rule.rstrip("/") if only_dir else rule
        if rule:
            rules.append((("^" if "/" in rule else "^(?:.*/)?") + glob_pattern(rule.removeprefix("/")) + "$", only_dir, back))
    return rules


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether an ignore file's lines leave a path out: the last that matches it decides, '!' takes back; what is in a folder left out can't be taken back."""
    rules = ignore_rules(lines)
    if not rules:
        return F.lit(False)

    def decided(name: Column, folder: bool) -> Column:
        out = F.lit(False)
        for pattern, only_dir, back in rules:
            if folder or not only_dir:
                out = F.when(name.rlike(pattern), F.lit(not back)).otherwise(out)
        return out

    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.exists(F.filter(above, lambda a: a != ""), lambda a: decided(a, True)) | decided(path, False)


MAX_BYTES = 400_000
IGNORE_FILES = (".gitignore", ".git/info/exclude")
FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.BinaryType()), T.StructField("size_bytes", T.LongType())])


def _walk(spark: SparkSession, root: str) -> list[tuple[str, str, int]]:
    """(path under root, full path, size) of all files but those in folders that are never indexed, which are not entered; links are not followed.

    The listing is the driver's, as that of any file source is; it holds names and sizes alone.
    """
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, waiting = [], [("", base)]
    while waiting:
        above, folder = waiting.pop()
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if status.isSymlink():
                continue
            if status.isDirectory():
                if name.lower() not in paths.EXCLUDED_DIRS and not name.lower().startswith(".git"):
                    waiting.append((f"{above}{name}/", status.getPath()))
            else:
                found.append((above + name, status.getPath().toString(), status.getLen()))
    return sorted(found)


def _content(spark: SparkSession, where: str) -> bytes:
    """A file's bytes, read by the driver through its file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path (under root), bytes, size_bytes of every file outside the folders that are never indexed.

    Only files of 1 to max_bytes bytes are opened; larger ones have null bytes, empty ones no bytes, and both rows stay, for they are counted.
    Tasks list folders and read files by their names as they are, see sources.repository; a root that only Spark's readers can open is listed by
    the driver and read by Spark, with the marks of globs in names escaped; files that Spark's readers pass over, whose names begin with '_' or '.', by the driver.
    """
    if reader.known(root):
        spark.dataSource.register(reader.RepositorySource)
        return spark.read.format("repository").options(root=root, max_bytes=str(max_bytes)).load()
    listed = _walk(spark, root)
    hidden = {p for p, f, n in listed if 0 < n <= max_bytes and p.rsplit("/", 1)[-1][0] in "._"}
    rest = spark.createDataFrame([(p, bytearray() if n == 0 else bytearray(_content(spark, f)) if p in hidden else None, n) for p, f, n in listed if p in hidden or not 0 < n <= max_bytes], FILE)
    full = [re.sub(r"([\\{}\[\]*?])", r"\\\1", f) for p, f, n in listed if 0 < n <= max_bytes and p not in hidden]
    if not full:
        return rest
    top = listed[0][1][: len(listed[0][1]) - len(listed[0][0])]
    raw = spark.read.format("binaryFile").load(full)
    return rest.unionByName(raw.select(F.expr(f"substring(path, {len(top) + 1})").alias("path"), F.col("content").alias("bytes"), F.col("length").alias("size_bytes")))


def ignore_lines(spark: SparkSession, root: str) -> list[str]:
    """The lines of a checkout's own ignore files, those of its root alone, in order."""
    jvm = spark.sparkContext._jvm
    lines = []
    for name in IGNORE_FILES:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            lines += _content(spark, path.toString()).decode("utf-8", "replace").splitlines()
    return lines


def decoded(files: DataFrame) -> DataFrame:
    """path, content (UTF-8, other bytes as U+FFFD), size_bytes, num_lines, language, is_code."""
    text = F.make_valid_utf8(F.col("bytes").cast("string"))
    rows = files.select("path", text.alias("content"), "size_bytes")
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + F.when(F.endswith("content", F.lit("\n")), 0).otherwise(1)
    return rows.select("path", "content", "size_bytes", lines.cast("long").alias("num_lines"), paths.language(F.col("path")).alias("language"), paths.is_code(F.col("path")).alias("is_code"))


def judged(files: DataFrame, ignore: list[str] | None = None, globs: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """decoded() rows with skip_reason, null for those to be indexed."""
    reason = paths.skip_reason(F.col("path"), F.col("content"), F.col("size_bytes"), ignored(F.col("path"), ignore or []), max_bytes)
    if globs:
        wanted = F.lit(False)
        for g in globs:
            wanted = wanted | F.col("path").rlike("^" + glob_pattern(g) + "$")
        reason = F.coalesce(reason, F.when(~wanted, "not_included"))
    return files.withColumn("skip_reason", reason)


def chosen(files: DataFrame, most: int = 4000) -> DataFrame:
    """The `most` most important files, by importance, then path."""
    rows = files.where("skip_reason IS NULL").withColumn("importance", paths.importance(F.col("path"), F.col("num_lines")))
    return rows.orderBy(F.desc("importance"), "path").limit(most)


def skip_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; blank lines and those that begin with // or # are left out, a malformed one is an error."""
    told = ~F.col("value").rlike("^\\s*(//|#|$)")
    lines = spark.read.text(path).where(told)
    # asked inside as well, as the planner may read values before it drops lines
    return lines.select(F.from_json(F.when(told, F.col("value")), CASE, {"mode": "FAILFAST"}).alias("c")).select("c.*")


def save_cases(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def diff(spark: SparkSession, path: str) -> DataFrame:
    """diff_id, text: a diff for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("diff_id"), F.col("value").alias("text"))


# What a repository may be named by.
SHORT = "^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"
URL = "^(?:https?|ssh|git)://|^git@"
PULL = "^(?:https?://[^/]+/)?([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)(?:#|/pull/)([0-9]+)/?$"


def repository(name: Column, local: Column) -> Column:
    """Kind and place of a repository's name: a known local directory, owner/name, or a URL; null for anything else."""
    place = lambda kind, where: F.struct(F.lit(kind).alias("kind"), where.alias("place"))
    short = F.regexp_replace(name, "\\.git$", "")
    return F.when(local, place("local", name)).when(name.rlike(SHORT), place("hosted", short)).when(name.rlike(URL), place("url", short))


def pull_request(ref: Column) -> Column:
    """repo and number of owner/name#n or a pull request's address; null for anything else."""
    return F.when(ref.rlike(PULL), F.struct(F.regexp_extract(ref, PULL, 1).alias("repo"), F.regexp_extract(ref, PULL, 2).cast("int").alias("number")))


def pull_request_of(ref: str | None, environment: dict[str, str], read: Callable[[str], str]) -> tuple[str, int] | None:
    """repo and number of owner/name#n, of a bare number in a workflow's repository, or of the event that started a workflow; None without any."""
    named = re.fullmatch(r"([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)#([0-9]+)", (ref or "").strip())
    if named:
        return named[1], int(named[2])
    repo = environment.get("GITHUB_REPOSITORY", "")
    if repo and re.fullmatch(r"#?[0-9]+", (ref or "").strip()):
        return repo, int(ref.strip().lstrip("#"))
    where = environment.get("GITHUB_EVENT_PATH")
    if ref or not where:
        return None
    event = json.loads(read(where))
    number = (event.get("pull_request") or {}).get("number") or event.get("number")
    repo = (event.get("repository") or {}).get("full_name") or repo
    return (repo, int(number)) if repo and number else None
