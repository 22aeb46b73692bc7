"""Cluster maps, sampling weights, and the cluster-balanced draw.

A cluster map is a long table ``source, cluster_id, member_id, ord``: ``source`` numbers the
input files, ``ord`` is the line a row stands on (0 in a store, where clusters go by id). A
cluster without members keeps one row with a NULL member, because it still takes its place in
the order of clusters. No step collects the members of a cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.keyed import uniform
from strandmill.operators.skew import HOT_ROWS, lookup_join
from strandmill.session import materialize

CLUSTER = ["source", "cluster_id"]
# Weights are counted in millionths, so that sums are exact whatever the order.
WEIGHT_UNIT = 1_000_000
# The sampler lays rows out by the first 4 hex digits of md5(id): 65,536 balanced buckets.
BUCKET_DIGITS = 4
# Average number of weighted rows per slice of the weight axis.
ROWS_PER_CELL = 64


def weight_of(n):
    """Weight of each member of a cluster of n; the cluster as a whole has n / (1 + ln n)."""
    return F.lit(1.0) / (F.lit(1.0) + F.ln(n))


def cluster_members(members: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Members in file order, with the place ``cluster_ord`` where their cluster first appears."""
    firsts = members.groupBy(*CLUSTER).agg(F.min("ord").alias("cluster_ord"))
    return lookup_join(
        members, firsts, CLUSTER, "inner", ["member_id", "ord"], hot_rows
    )


def cluster_filter(members: DataFrame, dataset: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keep the members whose id is in the dataset."""
    ids = dataset.select(F.col("id").cast("string").alias("member_id")).distinct()
    return lookup_join(
        members.filter(F.col("member_id").isNotNull()), ids, ["member_id"], "left_semi",
        salt_on=[*CLUSTER, "ord"], hot_rows=hot_rows, hot_in=members,
    )


def cluster_sizes(members: DataFrame) -> DataFrame:
    """Size, member weight and total mass of each cluster; repeats of a member count."""
    sizes = members.groupBy(*CLUSTER).agg(F.count("member_id").alias("n")).filter("n > 0")
    return sizes.withColumn("weight", weight_of(F.col("n"))).withColumn(
        "mass", F.col("n") * F.col("weight")
    )


def cluster_count(members: DataFrame) -> DataFrame:
    """Number of clusters with at least one member; the default sample size."""
    return cluster_sizes(members).agg(F.count(F.lit(1)).alias("n_clusters"))


def _matched(members: DataFrame, dataset: DataFrame, hot_rows: int) -> DataFrame:
    """Members with ``row_ord``, the last dataset row of their id, or NULL where there is none.

    Written once: cluster sizes are counted on it and then joined back to it.
    """
    last_rows = dataset.groupBy(F.col("id").cast("string").alias("member_id")).agg(
        F.max("row_ord").alias("row_ord")
    )
    rows = members.select(*CLUSTER, "member_id", "ord")
    matched = lookup_join(
        rows, last_rows, ["member_id"], "left", [*CLUSTER, "ord"], hot_rows, hot_in=members
    )
    return materialize(matched.select(*CLUSTER, "member_id", "ord", "row_ord"), "members")


def _matched_sizes(matched: DataFrame) -> DataFrame:
    return matched.groupBy(*CLUSTER).agg(
        F.count("row_ord").alias("n"), F.min("ord").alias("cluster_ord")
    ).filter("n > 0")


def _weights(matched: DataFrame, hot_rows: int) -> DataFrame:
    place = F.struct("source", "cluster_ord", "cluster_id")
    weighted = lookup_join(
        matched.filter("row_ord IS NOT NULL"), _matched_sizes(matched), CLUSTER, "inner",
        ["member_id", "ord"], hot_rows,
    )
    return weighted.groupBy(F.col("member_id").alias("id"), "row_ord").agg(
        F.max_by(weight_of(F.col("n")), place).alias("weight")
    )


def member_weights(members: DataFrame, dataset: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The dataset rows that can be drawn: ``id, row_ord, weight``.

    A member of several clusters keeps the weight of the cluster that comes last. Of dataset
    rows sharing an id only the last can be drawn.
    """
    return _weights(_matched(members, dataset, hot_rows), hot_rows)


def cluster_weights(dataset: DataFrame, members: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every dataset row (``id, row_ord``) with its sampling weight, 0.0 where it has none."""
    reachable = member_weights(members, dataset, hot_rows)
    rows = dataset.select(F.col("id").cast("string").alias("id"), "row_ord")
    return rows.join(reachable, ["id", "row_ord"], "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0.0))
    )


def balanced_sample(
    dataset: DataFrame, members: DataFrame, seed: int, k: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Draw dataset rows so that large clusters do not dominate: ``draw_id, id, row_ord``.

    By default as many draws as there are clusters with a member in the dataset. The weights
    (no texts) are written once, since the draw reads them three times.
    """
    matched = _matched(members, dataset, hot_rows)
    if k is None:
        k = _matched_sizes(matched).count()
    weights = materialize(_weights(matched, hot_rows), "weights")
    return weighted_sample(weights, k, seed, carry=["row_ord"])


def unclustered_rows(
    dataset: DataFrame, members: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Dataset rows that are never drawn: no cluster holds them, or a later row has their id."""
    drawn = _matched(members, dataset, hot_rows).filter("row_ord IS NOT NULL").select(
        F.col("member_id").alias("id"), "row_ord"
    ).distinct()
    rows = dataset.withColumn("id", F.col("id").cast("string"))
    return rows.join(drawn, ["id", "row_ord"], "left_anti")


def weighted_sample(
    weights: DataFrame, k: int, seed: int, key: str = "id", weight: str = "weight",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``k`` independent draws with replacement, probability proportional to weight.

    Rows take consecutive intervals of the weight axis and each draw is a point on it. Both are
    cut into equal cells of the axis; within a cell one sort places every draw right behind
    the start of the interval that holds it. Points are uniform on the axis and weights lie in
    [1 / (1 + ln n), 1], so cells are alike in size by construction.

    Weights are counted in parts of a power of ten, so that the largest has six digits at least.
    A weight above zero that still comes to nothing is an error, not a row left out. Columns to
    ``carry`` come along with the key.
    """
    spark = weights.sparkSession
    above = weights.filter(F.col(weight) > 0)
    largest = above.agg(F.max(weight)).first()[0]
    if largest is None:
        raise ValueError("no row has a weight above zero")
    unit = float(WEIGHT_UNIT * 10 ** max(0, math.ceil(-math.log10(largest))))
    parts = F.round(F.col(weight) * unit).cast("bigint")
    rows = above.select(
        key, F.struct(key, *carry).alias("_row"),
        F.when(parts > 0, parts).otherwise(
            F.raise_error(F.lit("a weight is less than a millionth of the largest")).cast("bigint")
        ).alias("_w"),
        F.conv(F.substring(F.md5(F.col(key)), 1, BUCKET_DIGITS), 16, 10)
        .cast("int").alias("_bucket"),
    )
    totals = rows.groupBy("_bucket").agg(
        F.sum("_w").alias("_total"), F.count(F.lit(1)).alias("_rows")
    )
    summary = totals.agg(F.sum("_total"), F.sum("_rows")).first()
    axis, n_rows = int(summary[0]), int(summary[1])
    width = max(1, -(-axis * ROWS_PER_CELL // n_rows))

    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    in_bucket = Window.partitionBy("_bucket").orderBy(key).rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        rows.withColumn("_local", F.coalesce(F.sum("_w").over(in_bucket), F.lit(0)))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("_start", F.col("_offset") + F.col("_local"))
        .withColumn(
            "_cell",
            F.expr(f"explode(sequence(_start div {width}, (_start + _w - 1) div {width}))"),
        )
        .select(
            "_cell", F.expr(f"greatest(_start, _cell * {width})").alias("_at"),
            F.lit(None).cast("bigint").alias("draw_id"), "_row",
        )
    )
    point = F.floor(uniform(seed, "draw", F.col("id")) * F.lit(float(axis))).cast("bigint")
    draws = spark.range(k).select(
        point.alias("_at"), F.col("id").alias("draw_id"),
        F.lit(None).cast(starts.schema["_row"].dataType).alias("_row"),
    ).withColumn("_cell", F.expr(f"_at div {width}"))
    along = Window.partitionBy("_cell").orderBy(F.col("_at"), F.col("draw_id").asc_nulls_first())
    return (
        starts.unionByName(draws)
        .withColumn("_row", F.last("_row", ignorenulls=True).over(along))
        .filter(F.col("draw_id").isNotNull())
        .select("draw_id", "_row.*")
    )
