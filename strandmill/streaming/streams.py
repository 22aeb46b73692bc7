"""The batch operators on streams of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandmill.functions.text import PAD, strip
from strandmill.operators.bpe import BpeModel
from strandmill.operators.labels import IGNORE, pad_batches
from strandmill.operators.metrics import metric_windows
from strandmill.operators.rowid import batch_number, with_row_id
from strandmill.plans.prepare import arrange_text, prepare_corpus
from strandmill.session import scratch


def stream_lines(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Lines of files as they arrive: ``id, text``.

    No running number exists across micro-batches, so an id is the hash of file and line;
    repeats of a line in a file share it.
    """
    return (
        spark.readStream.options(**options).text(folder)
        .select(F.col("_metadata.file_path").alias("_path"), strip(F.col("value")).alias("text"))
        .filter(F.col("text") != "")
        .select(F.md5(F.concat_ws("|", "_path", "text")).alias("id"), "text")
    )


def stream_prepare(lines: DataFrame, model: BpeModel | None = None, **options) -> DataFrame:
    """The training transform on a stream. It keeps no state, so a replay gives the same rows."""
    if model is None:
        return arrange_text(lines, **options)
    return prepare_corpus(lines, model, **options)


def token_batches(
    rows: DataFrame, model: BpeModel, batch_size: int = 4, key: str = "id", **options
) -> DataFrame:
    """Padded training rows of a bounded table, ``batch_size`` to a batch in the order of their keys:
    ``example, batch_id, id, is_fim, input_ids, attention_mask, labels``.

    Options as in ``prepare_corpus``.
    """
    prepared = prepare_corpus(rows.select(key, "text"), model, key=key, **options)
    also = {} if options.get("generate") else {"labels": IGNORE}
    numbered = with_row_id(prepared.select(key, "is_fim", "input_ids", *also), [key], "example")
    batched = numbered.withColumn("batch_id", batch_number(F.col("example"), batch_size))
    return pad_batches(batched, "batch_id", "input_ids", model.ids[PAD], also=also)


def token_writer(model: BpeModel, path: str, **options) -> Callable[[DataFrame, int], None]:
    """What writes a micro-batch as padded batches to a folder that its number names.

    A micro-batch that is replayed writes over what it wrote before, so nothing is there twice.
    """
    def write(rows: DataFrame, number: int) -> None:
        with scratch(rows.sparkSession):
            token_batches(rows, model, **options).write.mode("overwrite").parquet(
                f"{path}/micro_batch={number}"
            )

    return write


def stream_tokens(
    rows: DataFrame, model: BpeModel, path: str, checkpoint: str, **options
) -> StreamingQuery:
    """Write all rows ``id, text`` there are now as padded batches, and stop.

    Batches do not reach over micro-batches; ``micro_batch`` is a column of what is read back.
    """
    query = (
        rows.writeStream.foreachBatch(token_writer(model, path, **options))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def stream_metric_windows(rows: DataFrame, width: str, lateness: str) -> DataFrame:
    """Mean loss by tag per time window; windows close when the watermark has passed them."""
    return metric_windows(rows.withWatermark("ts", lateness), width)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all input there is now to Parquet and stop."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return query
