"""FASTA records as rows.

The text reader splits files at ``\\n>``, so a record is one row and large files stay
splittable. The separator swallows the ``>`` of every record but the first of a file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.text import stripped_lines
from strandmill.operators.rowid import offsets_before
from strandmill.session import materialize
from strandmill.sources.lines import BROADCAST_SPLITS, file_order, scan_text


def parse_records(
    df: DataFrame, chunk: Column, keep_empty: bool = False, keep_orphan: bool = True
) -> DataFrame:
    """Explode a text of whole records into ``id, text``.

    Lines are stripped before headers are recognised, so an indented ``>`` starts a record too.
    Text in front of the first header gets the id ``""``, or is dropped.
    """
    records = F.split(F.array_join(stripped_lines(chunk), "\n"), "\n(?=>)")
    rest = df.columns
    head = F.substring_index("_record", "\n", 1)
    has_header = F.col("_record").startswith(">")
    exploded = df.select(*rest, F.explode(records).alias("_record")).filter("_record != ''")
    parsed = exploded.select(
        *rest,
        has_header.alias("_has_header"),
        F.when(has_header, F.substring(head, F.lit(2), F.length(head))).otherwise("").alias("id"),
        F.replace(
            F.when(
                has_header,
                F.substring("_record", F.length(head) + F.lit(2), F.length("_record")),
            ).otherwise(F.col("_record")),
            F.lit("\n"), F.lit(""),
        ).alias("text"),
    )
    if not keep_empty:
        parsed = parsed.filter(F.col("text") != "")
    if not keep_orphan:
        parsed = parsed.filter("_has_header")
    return parsed.drop("_has_header")


def _marked_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each row is the first of its file. A task reads the rows of a split in their order."""
    last = None
    for batch in batches:
        file, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block_start"))
        fresh = np.ones(len(file), bool)
        fresh[1:] = (file[1:] != file[:-1]) | (block[1:] != block[:-1])
        if len(file):
            fresh[0] = (file[0], block[0]) != last
            last = (file[-1], block[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), pa.array(fresh & (block == 0)), batch.column("value")],
            ["file", "is_first", "value"],
        )


def read_fasta(
    spark: SparkSession, paths: Sequence[str], keep_empty: bool = False, keep_orphan: bool = True
) -> DataFrame:
    """Records of FASTA files: ``id`` (the whole header) and ``text``.

    The defaults read a corpus; ``keep_empty=True, keep_orphan=False`` reads as the evaluation
    does. Files are read once: the task that reads the beginning of a file sees its first row.
    A path listed twice counts twice.
    """
    scan = scan_text(spark, paths, lineSep="\n>")
    rows = scan.select(F.xxhash64("file_path").alias("file"), "block_start", "value").mapInArrow(
        _marked_first, "file bigint, is_first boolean, value string"
    )
    order = file_order(spark, scan, paths)
    if order is not None and len(set(paths)) < len(paths):
        times = order.select(F.xxhash64("file_path").alias("file"))
        if times.count() <= BROADCAST_SPLITS:
            times = F.broadcast(times)
        rows = rows.join(times, "file")
    chunk = F.when(F.col("is_first"), F.col("value")).otherwise(F.concat(F.lit(">"), "value"))
    return parse_records(rows.select(chunk.alias("_chunk")), F.col("_chunk"), keep_empty, keep_orphan).select(
        "id", "text"
    )


def _segments(file: str, text: str):
    """Joins the lines of each record of a sorted partition, one record in memory at a time."""
    names = ["part", "seen", "edge", "file", "id", "text"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, of_file, header, pieces = TaskContext.get().partitionId(), 0, None, None, []
        begun = False
        # The first record may belong to one that an earlier partition began.
        edge = True
        for batch in batches:
            files, lines = batch.column(file), batch.column(text).to_pylist()
            out: list[tuple] = []
            for name, line in zip(files.to_pylist(), lines):
                fresh = line is not None and line.startswith(">")
                if begun and (fresh or name != of_file):
                    out.append((part, seen, edge, of_file, header, "".join(pieces)))
                    edge, pieces, header = False, [], None
                begun, of_file = True, name
                if fresh:
                    seen += 1
                    header = line[1:]
                else:
                    pieces.append(line or "")
            if out:
                yield _as_batch(out, names, files.type)
        if begun:
            yield _as_batch([(part, seen, True, of_file, header, "".join(pieces))], names, files.type)

    return task


def _as_batch(rows: list[tuple], names: list[str], file_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.bool_(), file_type, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def segment_lines(
    lines: DataFrame, file: str = "file", line_no: str = "line_no", text: str = "line"
) -> DataFrame:
    """Records from lines that are rows already: ``file, record_no, id, text``.

    A record number is the running count of header lines, over all files in order. Lines are moved
    once, to be sorted; each partition joins its own records, and only its first and its last one
    are moved again, to meet what the partitions beside it have of the same record.
    """
    ordered = lines.select(file, line_no, text).repartitionByRange(file, line_no).sortWithinPartitions(file, line_no)
    schema = f"part int, seen bigint, edge boolean, file {lines.schema[file].dataType.simpleString()}, id string, text string"
    pieces = materialize(ordered.mapInArrow(_segments(file, text), schema), "segments")
    counts = pieces.groupBy(F.col("part").cast("bigint").alias("part")).agg(F.max("seen").alias("seen"))
    before = offsets_before(counts, "part", "seen", "before")
    records = pieces.join(F.broadcast(before), "part").select(
        "part", "edge", "file", (F.col("before") + F.col("seen")).alias("record_no"), "id", "text"
    )
    # At most two rows per partition.
    joined = records.where("edge").groupBy("file", "record_no").agg(
        F.max("id").alias("id"), F.array_sort(F.collect_list(F.struct("part", "text"))).alias("runs")
    ).select("file", "record_no", "id", F.array_join(F.col("runs.text"), "").alias("text"))
    whole = records.where("not edge").select("file", "record_no", "id", "text")
    return whole.unionByName(joined).where("text <> ''").select(
        F.col("file").alias(file), "record_no", F.coalesce("id", F.lit("")).alias("id"), "text"
    )
