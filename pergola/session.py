"""Session defaults for running the engine outside a cluster that sets its own."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local[cores] session in UTC with adaptive execution; keyword pairs override by full name."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pergola")
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": os.environ.get("PERGOLA_DRIVER_MEMORY", "8g"),
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder; a local session may go without and has a temporary folder, any other may not, as its executors would not see one another's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if base:
        return base.rstrip("/")
    if own.isDefined():
        return own.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/pergola-shared"


#: Lets Spark delete a job's shuffle files when the job has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, conf: dict[str, str] | None = None, **options: str) -> DataFrame:
    """The rows as a table in the shared folder, so that lineage ends and no executor's loss brings it back; it goes when the session's JVM ends.

    The shuffle files of the job that wrote it are deleted at once: the table takes their place, and nothing recomputes from them.
    conf: settings of the session while it is written. options: of the table's files.
    """
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    held = {CLEANUP: "true"} | (conf or {})
    before = {name: spark.conf.get(name, None) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        df.write.options(compression="zstd", **options).parquet(where)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


def spread(df: DataFrame) -> DataFrame:
    """A scan's rows on every core where a small table comes in fewer partitions than there are cores; a large one is left as it is."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def fingerprint(spark: SparkSession, where: str) -> str:
    """What tells a table's files from what they were: names, sizes and times of change of all files at a path."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(where)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(base, True)
    found = []
    while files.hasNext():
        status = files.next()
        found.append(f"{status.getPath()}\t{status.getLen()}\t{status.getModificationTime()}")
    return "\n".join(sorted(found))
