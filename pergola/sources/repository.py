"""A folder of files as a Python data source: folders are listed and files read in tasks, whatever their names.

    spark.dataSource.register(RepositorySource)
    spark.read.format("repository").option("root", "file:///checkout").load()

Options: root (a path or an address that pyarrow's file systems know), max_bytes, tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pergola.functions import paths

SCHEMA = "path string, bytes binary, size_bytes long"
MAX_BYTES = 400_000
#: Folders that the driver lists until there are so many parts to deal; tasks list the rest.
TASKS = 64
#: Files of a listed folder that one part reads.
FILES = 256


def entered(name: str) -> bool:
    """Whether a folder is looked into: not those that are never indexed, nor any that begins with .git."""
    return name.lower() not in paths.EXCLUDED_DIRS and not name.lower().startswith(".git")


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or an address and the place in it."""
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root.removeprefix("file:")))


def known(root: str) -> bool:
    """Whether this source can read it; other addresses are for Spark's own readers."""
    try:
        opened(root)
    except (ValueError, OSError, NotImplementedError, ImportError):
        return False
    return True


def listed(held: fs.FileSystem, base: str, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
    """The folders to be entered and the files (path under base, size) of one folder, in order of names; links are not followed."""
    folders, files = [], []
    for info in sorted(held.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))), key=lambda i: i.base_name):
        if isinstance(held, fs.LocalFileSystem) and os.path.islink(info.path):
            continue
        name = f"{folder}/{info.base_name}" if folder else info.base_name
        if info.type == fs.FileType.Directory:
            if entered(info.base_name):
                folders.append(name)
        elif info.type == fs.FileType.File:
            files.append((name, info.size))
    return folders, files


@dataclass
class Part(InputPartition):
    """A folder with all below it, or files."""

    folder: str | None
    files: tuple[tuple[str, int], ...] = ()


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"].rstrip("/") or "/"
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.tasks = int(options.get("tasks", TASKS))

    def partitions(self) -> list[Part]:
        """Folders level by level until there are enough of them to deal; what is below is listed by tasks."""
        held, base = opened(self.root)
        parts, waiting = [], [""]
        while waiting and len(parts) + len(waiting) < self.tasks:
            folders, files = listed(held, base, waiting.pop(0))
            waiting += folders
            parts += [Part(None, tuple(files[k : k + FILES])) for k in range(0, len(files), FILES)]
        return parts + [Part(f) for f in waiting]

    def read(self, partition: Part | None) -> Iterator[tuple[str, bytes | None, int]]:
        """path, bytes, size_bytes: of files of more than max_bytes no bytes are read, of empty ones there are none."""
        if partition is None:  # an empty folder has no parts
            return
        held, base = opened(self.root)
        waiting = [partition.folder] if partition.folder is not None else []
        files = list(partition.files)
        while True:
            for name, size in files:
                if size > self.max_bytes:
                    yield name, None, size
                else:
                    with held.open_input_stream(f"{base}/{name}", compression=None) as stream:
                        yield name, stream.read(), size
            if not waiting:
                return
            folders, files = listed(held, base, waiting.pop())
            waiting += reversed(folders)


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RepositoryReader:
        return RepositoryReader(self.options)
