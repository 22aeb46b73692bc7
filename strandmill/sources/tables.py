"""Indexes, named tables, corpora from several inputs, and arrays as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandmill.operators.structures import restrict_to_ids, structure_transform
from strandmill.sources.fasta import read_fasta
from strandmill.sources.lines import read_id_list, read_lines, split_store_url


def read_csv_index(
    spark: SparkSession, paths: Sequence[str], schema: StructType | str | None = None
) -> DataFrame:
    """Structure indexes with a header line, plus the file each row comes from.

    Without a schema types are inferred, which reads the index twice.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(list(paths)).withColumn("dataset", F.col("_metadata.file_path"))


def read_table(
    spark: SparkSession, path: str, split: str | None = None, text_column: str = "text",
    id_column: str = "id", split_column: str = "split",
) -> DataFrame:
    """``id, text`` of a Parquet table, or of one split of it; the filter reaches the scan."""
    table = spark.read.parquet(path)
    if split is not None:
        table = table.filter(F.col(split_column) == split)
    return table.select(
        F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")
    )


def read_structures(spark: SparkSession, url: str) -> DataFrame:
    """Residues of a store, restricted by the id list its ``#fragment`` names."""
    path, id_path = split_store_url(url)
    ids = read_id_list(spark, id_path) if id_path else None
    return restrict_to_ids(spark.read.parquet(path), ids).withColumn("dataset", F.lit(url))


def read_structure_index(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``id, dataset`` of every structure in the given stores."""
    stores = [read_structures(spark, url) for url in paths]
    ids = [s.select(F.col("chain_id").alias("id"), "dataset").distinct() for s in stores]
    return reduce(DataFrame.unionByName, ids)


def corpus_union(corpora: Sequence[DataFrame]) -> DataFrame:
    """All rows of the corpora, with the position of their corpus."""
    tagged = [c.select("id", "text", F.lit(i).alias("file_ord")) for i, c in enumerate(corpora)]
    return reduce(DataFrame.unionByName, tagged)


def tagged_splits(train: DataFrame, evaluation: DataFrame | None = None) -> DataFrame:
    parts = [train.withColumn("split", F.lit("train"))]
    if evaluation is not None:
        parts.append(evaluation.withColumn("split", F.lit("eval")))
    return reduce(DataFrame.unionByName, parts)


def batch_to_rows(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Rows from columns that hold one array per batch."""
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.explode(F.arrays_zip(*arrays)).alias("_row")).select(
        *rest, *[F.col(f"_row.{a}").alias(a) for a in arrays]
    )


def read_residues(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Residues of all structures in the given stores."""
    return reduce(DataFrame.unionByName, [read_structures(spark, url) for url in paths])


def read_indexed_residues(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Residues of the structures that indexes name; a path is ``store#index.csv``.

    An index is a CSV file with a column ``id``, or a folder of them; a store without one is
    read whole.
    """
    def read_one(url: str) -> DataFrame:
        store, index = split_store_url(url)
        ids = read_csv_index(spark, [index]).select(F.col("id").cast("string")) if index else None
        return restrict_to_ids(spark.read.parquet(store), ids).withColumn("dataset", F.lit(url))

    return reduce(DataFrame.unionByName, [read_one(url) for url in paths])


READERS: dict[str, Callable[[SparkSession, Sequence[str]], DataFrame]] = {
    "line": read_lines,
    "fasta": read_fasta,
    "foldcomp": read_residues,
    "pdb": read_indexed_residues,
}
# Formats whose rows are structures, and how residues become corpus rows.
TRANSFORMS: dict[str, Callable[..., DataFrame]] = {
    "foldcomp": structure_transform,
    "pdb": structure_transform,
}


def read_corpus(spark: SparkSession, data_format: str, paths: Sequence[str]) -> DataFrame:
    """Rows ``id, text`` of any format; structures go through the transform of their format."""
    rows = READERS[data_format](spark, paths)
    transform = TRANSFORMS.get(data_format)
    return transform(rows) if transform else rows
