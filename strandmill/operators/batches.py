"""Length-aware batch plans, epoch order, and picking the latest path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.keyed import uniform
from strandmill.operators.rowid import batch_number, with_row_id

CHUNK = 8
# Rows per sub-batch by the longest sequence of a chunk.
SIZE_ABOVE = ((700, 1), (500, 2), (200, 4))
FULL_SIZE = 8
CHECKPOINT = r"checkpoint-(\d+)$"
# Fixed value: output name by place in the chunk, file and chunk start.
OUT_NAME = "esm_%d.pdb_esm_%d_%d.pdb"


def sub_batch_size(longest: Column, chunk_rows: Column) -> Column:
    size = F.when(chunk_rows == 1, F.lit(FULL_SIZE))
    for above, rows in SIZE_ABOVE:
        size = size.when(longest > above, F.lit(rows))
    return size.otherwise(F.lit(FULL_SIZE))


def fold_batch_plan(numbered: DataFrame, length: str = "length") -> DataFrame:
    """Chunks of 8, sub-batches and output names for rows ``file_ord, row_id, length``.

    ``row_id`` counts from 0 within each file. A chunk is at most 8 rows, so the window is
    small. The plan needs lengths only; texts join it by row when they are folded.
    """
    start = batch_number(F.col("row_id"), CHUNK) * F.lit(CHUNK)
    chunk = Window.partitionBy("file_ord", "chunk_start")
    index = (F.col("row_id") - F.col("chunk_start")).cast("int")
    return (
        numbered.withColumn("chunk_start", start)
        .withColumn("max_length", F.max(length).over(chunk))
        .withColumn(
            "batch_size",
            sub_batch_size(F.col("max_length"), F.count(F.lit(1)).over(chunk)),
        )
        .withColumn("sub_batch", F.floor(index / F.col("batch_size")).cast("int"))
        .withColumn(
            "out_name",
            F.format_string(
                OUT_NAME, index + F.lit(1), F.col("file_ord"),
                F.col("chunk_start"),
            ),
        )
    )


def epoch_shuffle(ids: DataFrame, seed: int, epoch: int, key: str = "id") -> DataFrame:
    """A random order of the rows for one epoch: ``key, epoch_pos``. Keys must be unique."""
    drawn = ids.select(key, uniform(seed, f"epoch{epoch}", key).alias("_u"))
    return with_row_id(drawn, ["_u", key], out="epoch_pos").drop("_u")


def latest_by_suffix(paths: DataFrame, path: str = "path", by: Sequence[str] = ()) -> DataFrame:
    """The path with the highest checkpoint number, per group; other paths are ignored."""
    step = F.regexp_extract(path, CHECKPOINT, 1).cast("bigint")
    return (
        paths.filter(F.col(path).rlike(CHECKPOINT))
        .groupBy(*by)
        .agg(F.max_by(path, step).alias(path))
    )
