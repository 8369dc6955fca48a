"""A repository as a data source, and ignore files against git."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from pergola.sources import files, repository

NAMES = [
    "pages/[id].tsx", "a/{x}.py", "a/b*c.py", "a/q?.py", "__init__.py", ".env", "_hidden/._x.py", "node_modules/x/y.js", ".github/w.yml", ".gitignore", "deep/one/two/three/four/f.py", "empty.txt", "back\\slash.py", "sp ace/é ü.md", "large.bin",
]


@pytest.fixture
def root(tmp_path):
    for name in NAMES:
        where = tmp_path / name
        where.parent.mkdir(parents=True, exist_ok=True)
        where.write_bytes(b"" if name == "empty.txt" else b"x" * 900 if name == "large.bin" else name.encode())
    os.symlink(tmp_path / "a", tmp_path / "linked")
    os.symlink(tmp_path / "__init__.py", tmp_path / "link.py")
    return tmp_path


@pytest.mark.parametrize("tasks", [1, 4, 64])
def test_every_name_is_taken_literally(spark, root, tasks):
    spark.dataSource.register(repository.RepositorySource)
    found = spark.read.format("repository").options(root=f"file://{root}", max_bytes="500", tasks=str(tasks)).load()
    want = {n for n in NAMES if not n.startswith(("node_modules", ".github/"))}
    rows = {r.path: (r.bytes, r.size_bytes) for r in found.collect()}
    assert set(rows) == want
    assert all(rows[n] == (bytearray(n.encode()), len(n.encode())) for n in want - {"empty.txt", "large.bin"})
    assert rows["empty.txt"] == (bytearray(), 0) and rows["large.bin"] == (None, 900)
    assert found.rdd.getNumPartitions() > (1 if tasks == 1 else 3) - 1


def test_scan_equals_sparks_own_reader(spark, root, monkeypatch):
    own = {(r.path, bytes(r.bytes) if r.bytes is not None else None, r.size_bytes) for r in files.scan(spark, f"file://{root}", 500).collect()}
    monkeypatch.setattr(repository, "known", lambda _: False)
    other = {(r.path, bytes(r.bytes) if r.bytes is not None else None, r.size_bytes) for r in files.scan(spark, f"file://{root}", 500).collect()}
    assert own == {r for r in other if not r[0].startswith("link")}


def test_empty_folder(spark, tmp_path):
    assert files.scan(spark, f"file://{tmp_path}").count() == 0


RULES = [
    "*.py[cod]", "\\#notes", "\\!loud", "# a comment", "", "build/", "/top.txt", "docs/*.md", "!docs/keep.md", "a/**/z", "**/tmp", "logs/**", "!logs/keep.log", "x[!0-9]y", "trail\\ ", "spaces   ", "[ab]?.log", "out", "!out/deep/file.txt", "foo/*", "!foo/bar", "q\\*r", "s[[:digit:]]t", "!!odd", "m**n",
]
PATHS = [
    "a.pyc", "d/b.pyo", "b.py", "b.pyx", "#notes", "!loud", "# a comment", "build/x", "d/build/x/y", "build", "top.txt", "d/top.txt", "docs/a.md", "docs/keep.md", "docs/d/a.md", "a/z", "a/b/z", "a/b/c/z/f", "tmp/f", "d/tmp", "logs/a", "logs/keep.log",
    "logs/d/keep.log", "xay", "x1y", "x/y", "trail ", "trail", "spaces", "spaces   ", "a1.log", "c1.log", "d/bz.log", "out/deep/file.txt", "out", "foo/a", "foo/bar/b", "foo/bar", "q*r", "qxr", "s1t", "sxt", "!odd", "mxn", "m/n", "mn", "plain/file.txt",
]


def test_ignore_files_as_git_reads_them(spark, tmp_path):
    run = lambda *a, **k: subprocess.run(["git", *a], cwd=tmp_path, capture_output=True, text=True, **k)
    if run("init", "-q").returncode:
        pytest.skip("git is not here")
    (tmp_path / ".gitignore").write_text("\n".join(RULES) + "\n")
    # a file is told from a folder by what is there
    for p in sorted(PATHS, key=len, reverse=True):
        where = tmp_path / p
        if not where.exists():
            where.parent.mkdir(parents=True, exist_ok=True)
            where.write_text("x")
    kept = [p for p in PATHS if (tmp_path / p).is_file()]
    said = run("check-ignore", "--no-index", "-z", "--stdin", input="\0".join(kept)).stdout.split("\0")
    frame = spark.createDataFrame([(p,) for p in kept], "path string")
    found = {r.path for r in frame.where(files.ignored(F.col("path"), RULES)).collect()}
    assert found == {p for p in said if p}
    assert {"a.pyc", "#notes", "out/deep/file.txt", "foo/a"} <= found and not {"docs/keep.md", "foo/bar/b", "b.py"} & found
