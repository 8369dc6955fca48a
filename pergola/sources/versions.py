"""Versions of a folder: a small file names what belongs to each, is written last and never changed."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession


def name(version: int) -> str:
    return f"v{version:08d}"


def file_system(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def known(spark: SparkSession, path: str) -> list[int]:
    """The versions of a folder that are whole: those whose file is there."""
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[1:9]) for n in names if re.fullmatch(r"v[0-9]{8}\.json", n))


def publish(spark: SparkSession, path: str, version: int, held: dict) -> None:
    """Makes a version known; an error if another has taken its number."""
    fs, where = file_system(spark, f"{path}/{name(version)}.json")
    out = fs.create(where, False)
    try:
        out.write(json.dumps(held).encode())
    finally:
        out.close()


def read(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """A version's number and what belongs to it; the latest if none is given."""
    there = known(spark, path)
    if not there or (version is not None and version not in there):
        raise FileNotFoundError(f"no {'version' if version is None else f'version {version}'} at {path}")
    version = there[-1] if version is None else version
    return version, json.loads(spark.read.text(f"{path}/{name(version)}.json", wholetext=True).first().value)
