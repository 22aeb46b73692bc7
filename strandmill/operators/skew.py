"""Joins and ordered concatenation that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# A key is hot from this many rows on, and is cut into slices of about this size.
HOT_ROWS = 1_000_000
# A hot key also holds at least this part of the rows. So there are at most twice as many hot keys,
# and their list, which goes through the driver and is broadcast, is never cut.
HOT_PART = 4096
# A hot key shows up at least about this often in the sample it is looked for in.
SAMPLED_ROWS = 1000
# Rows without a key match nothing; they are spread over this many slices.
NULL_SLICES = 1024


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> list[Row]:
    """The hot keys of ``df`` with their number of slices; usually an empty list.

    Counted on a sample, so that distinct keys are not shuffled in full. A key judged wrongly
    costs time, never rows.
    """
    fraction = min(1.0, SAMPLED_ROWS / hot_rows)
    rows = df.select(*keys)
    if fraction < 1.0:
        rows = rows.sample(fraction, seed=1)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") >= max(1.0, hot_rows * fraction / 2)
    )
    if counts.isEmpty():
        return []
    sampled = rows.count()
    return (
        counts.filter(F.col("_n") >= sampled / (2 * HOT_PART))
        .orderBy(F.desc("_n"), *keys)
        .select(*keys, F.ceil(F.col("_n") / F.lit(hot_rows * fraction)).cast("int").alias("_slices"))
        .collect()
    )


def lookup_join(
    facts: DataFrame, dim: DataFrame, keys: Sequence[str], how: str,
    salt_on: Sequence[str], hot_rows: int = HOT_ROWS, hot_in: DataFrame | None = None,
) -> DataFrame:
    """Join ``facts`` to ``dim``, where any key of ``facts`` may be hot.

    Without hot keys this is the plain join, for Spark to plan. Otherwise rows of a hot key are
    cut into slices by a hash of ``salt_on`` (columns that tell the rows apart) and its ``dim``
    rows are repeated per slice. Every row takes part exactly once either way. Hot keys are
    looked for in ``hot_in``, where a table cheaper to read than ``facts`` has the same keys.
    """
    keys = list(keys)
    found = hot_keys(facts if hot_in is None else hot_in, keys, hot_rows)
    if not found:
        return facts.join(dim, keys, how)
    source = facts if hot_in is None else hot_in
    schema = StructType(
        [source.schema[k] for k in keys] + [StructField("_slices", IntegerType())]
    )
    hot = F.broadcast(facts.sparkSession.createDataFrame(found, schema))
    any_null = F.lit(False)
    for key in keys:
        any_null = any_null | F.col(key).isNull()
    row_hash = F.xxhash64(*salt_on)
    sliced = (
        facts.join(hot, keys, "left")
        .withColumn(
            "_slice",
            F.when(any_null, F.pmod(row_hash, F.lit(NULL_SLICES)))
            .otherwise(F.pmod(row_hash, F.coalesce("_slices", F.lit(1)))),
        )
        .drop("_slices")
    )
    last = F.coalesce("_slices", F.lit(1)).cast("bigint") - F.lit(1)
    repeated = (
        dim.join(hot, keys, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .drop("_slices")
    )
    return sliced.join(repeated, [*keys, "_slice"], how).drop("_slice")


def ordered_concat(
    df: DataFrame, keys: Sequence[str], order: str, text: str, out: str,
    sep: str = "", span: int = 1024,
) -> DataFrame:
    """Join the texts of each key in ``order``; ``order`` is an integer, unique within a key.

    Runs of ``span`` order values are joined first, so that no task sorts a whole key row by
    row; the second step only sees one string per run.
    """

    def joined(order_col: str, text_col: str):
        pairs = F.array_sort(F.collect_list(F.struct(order_col, text_col)))
        return F.array_join(F.transform(pairs, lambda p: p[text_col]), sep)

    runs = (
        df.withColumn("_run", F.floor(F.col(order) / F.lit(span)))
        .groupBy(*keys, "_run")
        .agg(joined(order, text).alias("_text"))
    )
    return runs.groupBy(*keys).agg(joined("_run", "_text").alias(out))
