"""Token ids, offsets, training labels and padding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from strandmill.operators.skew import HOT_ROWS, lookup_join

IGNORE = -100
# Largest vocabulary that is broadcast to all tasks; about 100 MB.
BROADCAST_TOKENS = 1_000_000


def token_ids(
    tokens: DataFrame, vocab: DataFrame, salt_on: list[str], unk_id: int,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Attach ``token_id`` to rows of ``token``.

    A vocabulary within the bound is broadcast, and the tokens stay where they are. With a
    larger one the tokens are shuffled, and frequent ones cut into slices.
    """
    if vocab.count() <= BROADCAST_TOKENS:
        joined = tokens.join(F.broadcast(vocab), "token", "left")
    else:
        joined = lookup_join(tokens, vocab, ["token"], "left", salt_on, hot_rows)
    return joined.withColumn("token_id", F.coalesce("token_id", F.lit(unk_id)))


@F.pandas_udf(ArrayType(IntegerType()))
def _ends(sizes: pd.Series) -> pd.Series:
    # One running sum over all rows laid end to end, less what lies before each row.
    counts = sizes.map(len).to_numpy(dtype="int64")
    flat = np.concatenate([np.zeros(0, "int64"), *sizes])
    ends = np.cumsum(flat)
    before = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
    return pd.Series(np.split((ends - np.repeat(before, counts)).astype("int32"), np.cumsum(counts)[:-1]))


def token_offsets(tokens: Column) -> Column:
    """Start and end of each token when the tokens are laid end to end."""
    ends = _ends(F.transform(tokens, F.length))
    return F.zip_with(
        tokens, ends, lambda t, end: F.struct((end - F.length(t)).alias("start"), end.alias("end"))
    )


def labels(ids: Column, mask: Column) -> Column:
    """Ids where the mask is set, the ignore index elsewhere."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m > 0, i).otherwise(F.lit(IGNORE)))


def sft_labels(plain: Column, middle_id: int) -> Column:
    """Labels after the first middle tag only; without that tag nothing contributes."""
    # Built from two pieces: a lambda over the array would look for the tag once per token.
    first = F.array_position(plain, middle_id).cast("int")
    cut = F.when(first > 0, first).otherwise(F.size(plain))
    return F.concat(
        F.array_repeat(F.lit(IGNORE), cut),
        F.slice(plain, cut + F.lit(1), F.size(plain) - cut),
    )


def pad_batches(
    df: DataFrame, batch: str, ids: str, pad_id: int, also: dict[str, int] | None = None
) -> DataFrame:
    """Pad every row to the longest of its batch and add the attention mask.

    ``also`` names more arrays to fill up to the same length, with their fill value. A batch is
    bounded, so rows are read once and meet by batch.
    """
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    fill = F.col("_longest") - F.size(ids)
    mask = F.concat(
        F.transform(F.col(ids), lambda _: F.lit(1)), F.array_repeat(F.lit(0), fill)
    )
    return (
        df.withColumn("_longest", longest)
        .withColumn("attention_mask", mask)
        .withColumns({
            name: F.concat(F.col(name), F.array_repeat(F.lit(value), fill))
            for name, value in (also or {}).items()
        })
        .withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad_id), fill)))
        .drop("_longest")
    )
