"""From ID-mapping triples to a cluster store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def idmapping_filter(
    triples: DataFrame, id_type: str = "UniRef50", key_format: str | None = None
) -> DataFrame:
    """Pairs of one id type; ``key_format`` is a ``%s`` pattern applied to the key."""
    key = F.col("key") if key_format is None else F.format_string(key_format, F.col("key"))
    return triples.filter(F.col("id_type") == id_type).select(
        F.col("value").alias("cluster_id"), key.alias("member_id")
    )


def idmapping_clusters(
    triples: DataFrame, id_type: str = "UniRef50", key_format: str | None = None
) -> DataFrame:
    """The set of (cluster, member) pairs. The mapped value is the cluster."""
    return idmapping_filter(triples, id_type, key_format).distinct()


def idmapping_key_count(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.countDistinct("cluster_id").alias("n_clusters"))
