"""Residue tables: lookup by id, per-residue features, chain sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions import residues as R
from strandmill.operators.skew import HOT_ROWS, lookup_join, ordered_concat

CHAIN = ["dataset", "chain_id"]


def with_defaults(residues: DataFrame, fill_value: float | Column) -> DataFrame:
    """Add ``coord_mask`` and ``residue_index`` where the table does not bring them."""
    if "coord_mask" not in residues.columns:
        residues = residues.withColumn("coord_mask", R.coord_mask(F.col("coords"), fill_value))
    if "residue_index" not in residues.columns:
        residues = residues.withColumn("residue_index", R.residue_number(F.col("residue_id")))
    return residues


def structure_lookup(
    index: DataFrame, residues: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Residues of the structures an index (``id, dataset``) names; other columns come along."""
    wanted = index.withColumnRenamed("id", "chain_id")
    return lookup_join(residues, wanted, CHAIN, "inner", [*CHAIN, "pos"], hot_rows)


def restrict_to_ids(
    residues: DataFrame, ids: DataFrame | None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Keep the structures of an id list; no list keeps all."""
    if ids is None:
        return residues
    wanted = ids.select(F.col("id").alias("chain_id")).distinct()
    return lookup_join(residues, wanted, ["chain_id"], "left_semi", [*CHAIN, "pos"], hot_rows)


def relative_index(residues: DataFrame) -> DataFrame:
    """``residue_idx``: residue number relative to the first residue of the chain.

    A chain is a molecule and so bounded: one read, and one shuffle that spreads chains.
    """
    of_chain = Window.partitionBy(*CHAIN).orderBy("pos")
    first = F.first("residue_index").over(of_chain)
    return residues.withColumn("residue_idx", F.col("residue_index") - first)


def residue_sequences(residues: DataFrame) -> DataFrame:
    """The letters of each chain as one text."""
    letters = residues.select(
        *CHAIN, "pos", R.residue_letter(F.col("residue_name")).alias("_letter")
    )
    return ordered_concat(letters, CHAIN, "pos", "_letter", "text")


def structure_features(residues: DataFrame, fill_value: float | Column) -> DataFrame:
    """All features, one row per residue."""
    full = relative_index(with_defaults(residues, fill_value))
    coords, mask = F.col("coords"), F.col("coord_mask")
    return full.select(
        *CHAIN, "pos", "residue_idx",
        R.residue_letter(F.col("residue_name")).alias("letter"),
        "coords", "coord_mask",
        F.struct(
            R.pseudo_beta(coords, F.col("residue_type")).alias("pseudo_beta"),
            R.pseudo_beta_mask(mask, F.col("residue_type")).alias("mask"),
        ).alias("distogram"),
        R.backbone(coords, mask).alias("backbone"),
    )


def chain_features(residues: DataFrame, fill_value: float | Column) -> DataFrame:
    """All features, one row per chain, as arrays in the order of the residues.

    Needs no window: the first residue's number is the first of the ordered array.
    """
    full = with_defaults(residues, fill_value)
    coords, mask = F.col("coords"), F.col("coord_mask")
    residue = F.struct(
        "pos", "residue_index", R.residue_letter(F.col("residue_name")).alias("letter"),
        coords.alias("coords"), mask.alias("coord_mask"),
        R.pseudo_beta(coords, F.col("residue_type")).alias("pseudo_beta"),
        R.pseudo_beta_mask(mask, F.col("residue_type")).alias("pseudo_beta_mask"),
        R.backbone(coords, mask).alias("backbone"),
    )
    chains = full.groupBy(*CHAIN).agg(F.collect_list(residue).alias("_r"))
    # Only places are compared, so that coordinates never are.
    ordered = F.array_sort("_r", lambda a, b: a["pos"].cast("int") - b["pos"].cast("int"))
    each = lambda name: F.transform("_r", lambda r: r[name]).alias(name)
    return chains.withColumn("_r", ordered).select(
        *CHAIN, F.size("_r").alias("n_residues"),
        F.transform("_r", lambda r: r["residue_index"] - F.col("_r")[0]["residue_index"]).alias("residue_idx"),
        F.array_join(F.transform("_r", lambda r: r["letter"]), "").alias("text"),
        *(each(name) for name in ("coords", "coord_mask", "pseudo_beta", "pseudo_beta_mask", "backbone")),
    )


def structure_transform(residues: DataFrame) -> DataFrame:
    """Chains as corpus rows ``id, dataset, text``, ready for the sequence operators."""
    return residue_sequences(residues).withColumnRenamed("chain_id", "id")
