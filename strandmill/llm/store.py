"""Tables written once to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandmill.session import fresh_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors reach, and read back.

    Cuts lineage: work already done outlives lost executors, and later plans start from files.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids that are sent to every task at most: 32 MB of them.
SENT_IDS = 2_000_000


def semi_join(
    df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi",
    sent_ids: int | None = None,
) -> DataFrame:
    """Rows of ``df`` whose key is in the stored table ``ids`` (or is not: ``left_anti``).

    Ids are counted first. Few enough are sent to all tasks and the rows stay where they are;
    more are joined by a shuffle of both sides.
    """
    return df.join(ids.hint(how_to_send(ids, SENT_IDS if sent_ids is None else sent_ids)), key, how)


def how_to_send(table: DataFrame, rows: int) -> str:
    """The hint for a stored table in a join: broadcast up to so many rows, a shuffle beyond."""
    return "broadcast" if table.count() <= rows else "merge"
