"""Cluster maps and ID-mapping triples as long tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.text import strip
from strandmill.sources.lines import read_lines


def explode_cluster_lines(
    lines: DataFrame, text: str = "text", ord_col: str = "id", sep: str = "\t",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``cluster_id <tab> member...`` lines to ``cluster_id, member_id, ord, pos``.

    A line without members gives one row with a NULL member. Columns to ``keep`` come first.
    """
    parts = F.split(text, sep)
    members = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - F.lit(1), F.lit(0)))
    return lines.select(
        *keep, parts[0].alias("cluster_id"), F.col(ord_col).alias("ord"),
        F.posexplode_outer(members).alias("pos", "member_id"),
    ).select(*keep, "cluster_id", "member_id", "ord", "pos")


def read_cluster_store(spark: SparkSession, path: str) -> DataFrame:
    """A store written by ``write_cluster_store``; its clusters are ordered by id."""
    return spark.read.schema("cluster_id string, member_id string").parquet(path).select(
        "cluster_id", "member_id", F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("pos")
    )


def read_cluster_map(spark: SparkSession, paths: Sequence[str], sep: str = "\t") -> DataFrame:
    """Cluster files and stores (``.db``) as one map: ``source, cluster_id, member_id, ord``.

    All files are one scan; ``source`` is the position in ``paths``.
    """
    stores = [i for i, path in enumerate(paths) if path.endswith(".db")]
    files = [i for i, path in enumerate(paths) if not path.endswith(".db")]
    parts = [read_cluster_store(spark, paths[i]).withColumn("source", F.lit(i)) for i in stores]
    if files:
        lines = read_lines(spark, [paths[i] for i in files], per_path=True)
        source = F.element_at(F.array(*map(F.lit, files)), F.col("file_ord") + 1)
        lines = lines.withColumn("source", source)
        parts.append(explode_cluster_lines(lines, sep=sep, keep=["source"]))
    return reduce(DataFrame.unionByName, parts).select("source", "cluster_id", "member_id", "ord", "pos")


def parse_idmapping(lines: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Triples ``key, id_type, value``, and the lines that have not exactly three fields."""
    fields = F.split(text, "\t")
    good = F.size(fields) == 3
    triples = lines.filter(good).select(
        fields[0].alias("key"), fields[1].alias("id_type"), fields[2].alias("value")
    )
    return triples, lines.filter(~good).select(F.col(text).alias("line"))


def read_idmapping(
    spark: SparkSession, path: str, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """ID-mapping triples, and the lines that are none.

    A malformed line is an error, or with ``strict=False`` a row ``line`` of the second table.
    """
    lines = (
        spark.read.text(path)
        .select(strip(F.col("value")).alias("text"))
        .filter(F.col("text") != "")
    )
    triples, rejects = parse_idmapping(lines)
    if not strict:
        return triples, rejects
    fields = F.split("text", "\t")
    message = F.concat(F.lit("expected three tab-separated fields: "), F.col("text"))
    checked = F.when(F.size(fields) == 3, fields).otherwise(
        F.raise_error(message).cast("array<string>")
    )
    triples = lines.select(checked.alias("f")).select(
        F.col("f")[0].alias("key"), F.col("f")[1].alias("id_type"), F.col("f")[2].alias("value")
    )
    return triples, rejects.limit(0)
