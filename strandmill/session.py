"""Session helpers: the shared folder, written intermediate tables, stable file splits."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
_scope: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it gets a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="strandmill-")
    return _local_dirs[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, inside the innermost ``scratch`` block if there is one."""
    folder = _scope.get() or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written in the block live as long as the block.

    What is to outlast it takes its path before the block begins. Without a block, written
    tables stay until the shared folder is cleaned.
    """
    folder = fresh_path(spark, "scratch")
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a table this package wrote, on whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and makes everything computed from the result consistent: values such as
    ``monotonically_increasing_id`` are fixed on disk, whichever executors are lost later.
    A given ``path`` is written over.
    """
    spark = df.sparkSession
    mode = "errorifexists" if path is None else "overwrite"
    path = path or fresh_path(spark, name)
    df.write.mode(mode).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def two_paths(spark: SparkSession, name: str) -> Iterator[str]:
    """Two paths in turn, for a loop whose next table is computed from the last one."""
    return itertools.cycle([fresh_path(spark, name), fresh_path(spark, name)])


def pinned_session(spark: SparkSession) -> SparkSession:
    """A session like this one that always cuts files into the same splits.

    Spark derives the split size of small inputs from the number of cores it has at that moment.
    Readers that scan a file twice and match rows by split need both scans cut alike, also when
    executors come and go in between. Settings of the caller's session stay as they are.
    """
    pinned = spark.newSession()
    for row in spark.sql("SET").collect():
        if row["key"].startswith("spark.sql.") and spark.conf.isModifiable(row["key"]):
            pinned.conf.set(row["key"], row["value"])
    least = "spark.sql.files.minPartitionNum"
    if pinned.conf.get(least, None) is None:
        pinned.conf.set(least, str(spark.sparkContext.defaultParallelism))
    return pinned


def spread(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows over all cores, ahead of work that is heavy per byte, where a scan has fewer tasks than
    there are cores. Scans with as many or more, and streams, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, F.xxhash64(*by))
