"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.store import stored


def _least_neighbour(links: DataFrame) -> DataFrame:
    """``links`` (a, b) with ``low``, the least of a and its neighbours."""
    low = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return links.join(low, "a")


def _two_rows(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (a, b) from these pairs of columns of each row; what makes the rows is run once."""
    return rows.select(
        F.inline(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs)))
    )


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (key, label) of all keys in ``links`` (a, b): label is the least key that is reached.

    Every round hangs larger neighbours, then smaller ones, under a key's least neighbour, until
    all links lead to a least key. Keys with many neighbours are reduced before they are moved;
    each round is written, so rounds that are done stay done. Links of a key to itself, repeated
    links and none at all are allowed; null keys are not.
    """
    now = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b").distinct(),
        "links",
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = _two_rows(now, ("a", "b"), ("b", "a"))
        large = (
            _least_neighbour(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .where("a <> b").distinct()
        )
        small = _least_neighbour(large)
        now = stored(
            _two_rows(small, ("b", "low"), ("a", "low")).where("a <> b").distinct(), "links",
        )
    return now.select(F.col("a").alias("key"), F.col("b").alias("label")).unionByName(
        now.select(F.col("b").alias("key"), F.col("b").alias("label")).distinct()
    )
