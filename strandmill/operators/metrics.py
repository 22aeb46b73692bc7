"""Training metrics by FIM / standard tag: per step, per logging interval, per time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = ("fim", "std")


def _tag_counts(loss_scale: int) -> list[Column]:
    return [
        (F.count_if(F.col("is_fim")) * loss_scale).alias("n_fim"),
        (F.count_if(~F.col("is_fim")) * loss_scale).alias("n_std"),
    ]


def metric_counts(rows: DataFrame, loss_scale: int = 1) -> DataFrame:
    """Rows of each kind per step and phase, scaled by the number of replicas."""
    return rows.groupBy("phase", "step").agg(*_tag_counts(loss_scale))


def metric_loss_by_tag(
    rows: DataFrame, loss: str = "loss", loss_scale: int = 1
) -> DataFrame:
    """The mean loss of a step, shared out by tag: loss * n_tag / (n_fim + n_std).

    A tag without rows in a step is not logged (NULL).
    """
    per_step = rows.groupBy("phase", "step").agg(
        *_tag_counts(loss_scale), (F.avg(loss) * loss_scale).alias("_loss")
    )
    share = F.col("_loss") / (F.col("n_fim") + F.col("n_std"))
    for tag in TAGS:
        n = F.col(f"n_{tag}")
        per_step = per_step.withColumn(f"loss_{tag}", F.when(n > 0, share * n))
    return per_step.drop("_loss")


def metric_rollup(per_step: DataFrame, logging_steps: int = 10) -> DataFrame:
    """Mean of every logged metric per logging interval."""
    metrics = [c for c in per_step.columns if c not in ("phase", "step")]
    interval = F.floor(F.col("step") / F.lit(logging_steps)).cast("bigint")
    return per_step.groupBy("phase", interval.alias("interval")).agg(
        *[F.avg(m).alias(m) for m in metrics]
    )


def metric_windows(rows: DataFrame, width: str, loss: str = "loss") -> DataFrame:
    """Mean loss and row count by tag per tumbling time window; batch or streaming."""
    tag = F.when(F.col("is_fim"), F.lit("fim")).otherwise(F.lit("std"))
    return (
        rows.groupBy(F.window("ts", width).alias("_window"), tag.alias("tag"))
        .agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))
        .select(F.col("_window.start").alias("window_start"), "tag", "loss", "n")
    )
