"""Global row ids and running totals without a single-task window.

Rows are range partitioned and sorted once and written to the shared folder; ids are then the
position inside a partition plus the size of the partitions before it. The only table that
goes through the driver or is broadcast has one row per shuffle partition.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.session import materialize

_INDEX_MASK = (1 << 33) - 1


def _placed(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """Globally sorted copy of ``df`` with partition number and position, fixed on disk."""
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = materialize(ordered.withColumn("_mid", F.monotonically_increasing_id()), name)
    return placed.withColumn("_part", F.shiftrightunsigned("_mid", 33)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit(_INDEX_MASK))
    )


def offsets_before(parts: DataFrame, part: str, amount: str, out: str) -> DataFrame:
    """For each partition the sum of ``amount`` over the partitions with a lower number.

    ``parts`` has one row per partition, so it is summed up by the driver.
    """
    amounts = sorted((r[0], r[1] or 0) for r in parts.select(part, amount).collect())
    before = itertools.accumulate((n for _, n in amounts), initial=0)
    rows = [(number, total) for (number, _), total in zip(amounts, before)]
    return parts.sparkSession.createDataFrame(rows, f"{part} bigint, {out} bigint")


def _offsets(placed: DataFrame, amount: Column) -> DataFrame:
    return offsets_before(placed.groupBy("_part").agg(amount.alias("_amount")), "_part", "_amount", "_offset")


def with_row_id(df: DataFrame, order_by: Sequence[str], out: str = "row_id") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of ``order_by``, which must be unique."""
    placed = _placed(df, order_by, "row-id")
    offsets = _offsets(placed, F.count(F.lit(1)))
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_pos")).alias(out)
    )


def running_total(
    df: DataFrame, order_by: Sequence[str], value: str, out: str, inclusive: bool = False
) -> DataFrame:
    """Sum of ``value`` over all rows before (or up to) each row in the order of ``order_by``."""
    placed = _placed(df, order_by, "running-total")
    offsets = _offsets(placed, F.sum(value))
    within = Window.partitionBy("_part").orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    local = F.coalesce(F.sum(value).over(within), F.lit(0))
    return (
        placed.withColumn("_local", local)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_offset") + F.col("_local")).alias(out))
    )


def batch_number(row_id: Column, size: int) -> Column:
    return F.floor(row_id / F.lit(size)).cast("bigint")
