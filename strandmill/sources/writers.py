"""Sinks: FASTA files, cluster stores, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.text import fasta_record


def write_fasta(
    df: DataFrame, path: str, header: str = "id", text: str = "text",
    compression: str | None = None,
) -> None:
    """One FASTA record per row, wrapped at 60, as a folder of text files."""
    lines = df.select(fasta_record(F.col(header), F.col(text)).alias("value"))
    lines.write.text(path, compression=compression or "none")


def clean_path(path: str) -> str:
    """Default output of the FIM clean-up: the input name without extension, then a suffix."""
    return f"{path.rsplit('.', 1)[0]}_clean.fasta"


def write_cluster_store(pairs: DataFrame, path: str) -> None:
    """The set of (cluster, member) pairs, globally sorted; an existing target is refused.

    The range covers both columns, so a hot cluster spreads over several files.
    """
    order = ["cluster_id", "member_id"]
    (
        pairs.select(*order).distinct()
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .write.mode("errorifexists").parquet(path)
    )


def write_vocab(vocab: DataFrame, path: str) -> None:
    """``token <tab> id`` lines; in a token, line feeds and backslashes are escaped."""
    token = F.replace(F.col("token"), F.lit("\\"), F.lit("\\\\"))
    token = F.replace(token, F.lit("\n"), F.lit("\\n"))
    line = F.concat_ws("\t", token, F.col("token_id").cast("string"))
    vocab.select(line.alias("value")).write.text(path)


def read_vocab(spark, path: str) -> DataFrame:
    """Tokens and ids of ``write_vocab``: the id follows the last tab of a line."""
    token = F.regexp_replace("value", r"\t[^\t]*$", "")
    # An escape is read with the backslash before it, so that no pair is taken apart.
    token = F.regexp_replace(token, r"\G((?:[^\\]|\\\\)*+)\\n", "$1\n")
    return spark.read.text(path, lineSep="\n").select(
        F.replace(token, F.lit("\\\\"), F.lit("\\")).alias("token"),
        F.substring_index("value", "\t", -1).cast("int").alias("token_id"),
    )
