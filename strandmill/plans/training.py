"""The path from a corpus table to padded training batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.text import PAD
from strandmill.operators.batches import epoch_shuffle
from strandmill.operators.bpe import BpeModel
from strandmill.operators.clusters import balanced_sample
from strandmill.operators.labels import IGNORE, pad_batches
from strandmill.operators.rowid import batch_number
from strandmill.plans.prepare import prepare_corpus
from strandmill.session import materialize


def examples(
    corpus: DataFrame, members: DataFrame | None, seed: int, epoch: int = 0, k: int | None = None
) -> DataFrame:
    """The examples of one epoch in order: ``example, id, text``.

    ``corpus`` is a table ``id, row_ord, text``; ``row_ord`` orders rows of the same id. With a
    cluster map the i-th draw is the i-th example; without, the epoch is a random order of all
    rows. Only keys are drawn or ordered; texts join them at the end.
    """
    rows = corpus.withColumn("id", F.col("id").cast("string"))
    if members is not None:
        picked = balanced_sample(rows.select("id", "row_ord"), members, seed + epoch, k)
        picked = picked.withColumnRenamed("draw_id", "example")
        return picked.join(rows, ["id", "row_ord"]).select("example", "id", "text")
    keyed = rows.withColumn("_key", F.concat_ws("|", "id", F.col("row_ord").cast("string")))
    order = epoch_shuffle(keyed.select("_key"), seed, epoch, key="_key")
    return keyed.join(order, "_key").select(F.col("epoch_pos").alias("example"), "id", "text")


def training_batches(
    corpus: DataFrame, model: BpeModel, *, seed: int, members: DataFrame | None = None,
    epoch: int = 0, k: int | None = None, batch_size: int = 4, **options,
) -> DataFrame:
    """Padded rows of one epoch with ``batch_id`` and ``example``; options as in ``prepare_corpus``.

    Crop and cuts are drawn per example, so a row drawn twice is cut anew; whether to rearrange
    is drawn per batch. Token rows are written once: lost padding tasks do not encode anew.
    """
    picked = examples(corpus, members, seed, epoch, k)
    keyed = picked.withColumn(
        "batch_id", batch_number(F.col("example"), batch_size)
    ).withColumns({
        "_key": F.concat_ws(":", F.lit(str(epoch)), F.col("example").cast("string")),
        "_batch_key": F.concat_ws(":", F.lit(str(epoch)), F.col("batch_id").cast("string")),
    })
    prepared = prepare_corpus(
        keyed, model, seed=seed, key="_key", batch_key="_batch_key", **options
    ).drop("_key", "_batch_key", "attention_mask", "text")
    also = {} if options.get("generate") else {"labels": IGNORE}
    return pad_batches(
        materialize(prepared, "tokens"), "batch_id", "input_ids", model.ids[PAD], also=also
    )
