"""File-to-file jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.fim import defim_reconstruct, defim_strip
from strandmill.functions.text import generated_header
from strandmill.operators.idmapping import idmapping_filter
from strandmill.sources.clusters import read_idmapping
from strandmill.sources.fasta import read_fasta
from strandmill.sources.writers import clean_path, write_cluster_store, write_fasta


def clean_fasta(
    spark: SparkSession, path: str, out: str | None = None, strip_only: bool = False
) -> str:
    """Rewrite a FASTA file with rearranged texts put back, or only freed of their tags."""
    out = out or clean_path(path)
    clean = defim_strip if strip_only else defim_reconstruct
    write_fasta(read_fasta(spark, [path]).withColumn("text", clean(F.col("text"))), out)
    return out


def count_records(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.col("value").startswith(">")).count()


def write_generated(df: DataFrame, out: str, prefix: str, index: str = "index", text: str = "text") -> None:
    """Generated texts as FASTA with numbered headers that carry the length."""
    header = generated_header(prefix, F.col(index), F.col(text))
    write_fasta(df.select(header.alias("id"), F.col(text).alias("text")), out)


def build_cluster_store(
    spark: SparkSession, mapping: str, out: str, id_type: str = "UniRef50",
    key_format: str | None = None, strict: bool = True,
) -> int:
    """ID-mapping file to cluster store; returns the number of clusters.

    With ``strict=False`` malformed lines are written to ``<out>.rejects``.
    """
    triples, rejects = read_idmapping(spark, mapping, strict)
    if not strict:
        rejects.write.text(f"{out}.rejects")
    write_cluster_store(idmapping_filter(triples, id_type, key_format), out)
    return spark.read.parquet(out).select("cluster_id").distinct().count()
