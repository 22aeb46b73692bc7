"""Text sources: one sequence per line, and id lists."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote, urldefrag

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.text import strip
from strandmill.operators.rowid import running_total
from strandmill.session import fresh_path, pinned_session

SPLIT = ["file_ord", "file_path", "block_start"]
# Largest split table that is broadcast, by integer keys: about 200 MB, for 500 TB of text in
# splits of 128 MB. Larger ones join by shuffle.
BROADCAST_SPLITS = 4_000_000
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]+:")


def scan_text(spark: SparkSession, paths: Sequence[str], **options: str) -> DataFrame:
    """Rows of text files with the split they come from: one scan of all files of all paths.

    A path may be a folder or a pattern. ``.gz`` files are decompressed by their suffix. A file
    that several paths lead to is scanned once; see ``file_order``. A folder with partition
    folders in it is read by itself, without other paths.
    """
    reader = spark.read.options(**options)
    scan = reader.text(sorted(set(paths)))
    if len(paths) > 1:
        owners = _owners(spark, scan, paths)
        if any(len(o) > 1 for o in owners.values()):
            scan = reader.text([unquote(f) for f in owners])
    return scan.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"), "value",
    )


def _no_empty_host(uri: str) -> str:
    """As ``_metadata.file_path`` writes locations: ``file:/a``, not ``file:///a``."""
    return re.sub(r"^([A-Za-z0-9+.-]+:)//(?=/)", r"\1", uri)


def _plain(uri: str) -> str:
    """A location written one way, without escapes and slash at the end."""
    return _no_empty_host(unquote(uri)).rstrip("/")


def _owners(spark: SparkSession, scan: DataFrame, paths: Sequence[str]) -> dict[str, list[int]]:
    """Positions of the paths that lead to each file of the scan.

    Files are named by their paths or lie in folders that are; only a path that names neither, such
    as a pattern, is listed again.
    """
    conf = spark._jsc.hadoopConfiguration()
    here = spark._jvm.org.apache.hadoop.fs.FileSystem.get(conf).getWorkingDirectory().toString()
    root = re.match(r"^[^:]+:(//[^/]*)?", here).group()
    roots: dict[str, list[int]] = {}
    for i, path in enumerate(paths):
        full = path if _SCHEME.match(path) else root + path if path.startswith("/") else f"{here}/{path}"
        roots.setdefault(_plain(full), []).append(i)
    owners: dict[str, list[int]] = {f: [] for f in scan.inputFiles()}
    met = set()
    for file, found in owners.items():
        at = _plain(file)
        for place in {at, at.rpartition("/")[0]} & roots.keys():
            met.add(place)
            found += roots[place]
    for place in roots.keys() - met:
        for file in spark.read.text(paths[roots[place][0]]).inputFiles():
            owners.setdefault(file, []).extend(roots[place])
    return owners


def file_order(spark: SparkSession, scan: DataFrame, paths: Sequence[str]) -> DataFrame | None:
    """Rows (file_path, file_ord): positions in ``paths`` that lead to each file, or None for one path."""
    if len(paths) == 1:
        return None
    rows = [(_no_empty_host(f), i) for f, found in _owners(spark, scan, paths).items() for i in found]
    return spark.createDataFrame(rows, "file_path string, file_ord int")


def split_bound(scan: DataFrame) -> int:
    """Upper bound on the number of file splits: a partition packs whole files or one piece."""
    return len(scan.inputFiles()) + scan.rdd.getNumPartitions()


def read_lines(spark: SparkSession, paths: Sequence[str], per_path: bool = False) -> DataFrame:
    """Stripped non-blank lines with a 0-based id running over all files: ``id, text, file_ord``.

    ``file_ord`` is the position in ``paths``, and a path listed twice counts twice. Files of a folder
    or pattern are ordered by name. With ``per_path`` ids start anew for each path. Two passes and
    no shuffle of the text: the first counts lines per file split, and a table with a row per split
    is summed up partition by partition; the second adds the sum before its split to each line's place.
    """
    scan = scan_text(pinned_session(spark), paths)
    lines = (
        scan.withColumn("text", strip(F.col("value")))
        .filter(F.col("text") != "")
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_path", F.xxhash64("file_path"))
        .drop("value")
    )
    counted = lines.groupBy("file_path", "_path", "block_start").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_lines")
    )
    path = fresh_path(spark, "splits")
    counted.write.parquet(path)
    splits = spark.read.schema(counted.schema).parquet(path)
    order = file_order(spark, scan, paths)
    splits = splits.withColumn("file_ord", F.lit(0)) if order is None else splits.join(order, "file_path")
    before = running_total(splits, SPLIT, "_lines", "_before")
    if per_path:
        starts = before.groupBy("file_ord").agg(F.min("_before").alias("_start"))
        before = before.join(starts, "file_ord").withColumn("_before", F.col("_before") - F.col("_start"))
    offsets = before.select("file_ord", "_path", "block_start", "_first", "_before")
    if split_bound(scan) <= BROADCAST_SPLITS // len(paths):
        offsets = F.broadcast(offsets)
    row_id = F.col("_before") + F.col("_mid") - F.col("_first")
    # The caller's table comes first, so the result is of the caller's session.
    return offsets.join(lines, ["_path", "block_start"]).select(row_id.alias("id"), "text", "file_ord")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids, one per line; lines starting with ``#`` are comments."""
    return (
        spark.read.text(path)
        .select(strip(F.col("value")).alias("id"))
        .filter((F.col("id") != "") & ~F.col("id").startswith("#"))
    )


def split_store_url(url: str) -> tuple[str, str | None]:
    """A store location and the id-list path of its optional ``#fragment``."""
    store, ids = urldefrag(url)
    return store, ids or None
