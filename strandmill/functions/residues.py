"""Columns over residue rows: letters, indices, masks, pseudo-beta and backbone atoms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter to one-letter residue codes.
RESIDUE_LETTERS = {
    "ALA": "A", "CYS": "C", "ASP": "D", "GLU": "E", "PHE": "F",
    "GLY": "G", "HIS": "H", "ILE": "I", "LYS": "K", "LEU": "L",
    "MET": "M", "ASN": "N", "PRO": "P", "GLN": "Q", "ARG": "R",
    "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y",
}
DEFAULT_LETTER = "A"
# Atom order in a coordinate array, and the type number of glycine.
N, CA, C, CB = range(4)
GLYCINE = 7


def residue_letter(code: Column) -> Column:
    pairs = [F.lit(x) for item in RESIDUE_LETTERS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(DEFAULT_LETTER))


def residue_number(residue_id: Column) -> Column:
    """Number in ``chain:name:number``; a non-numeric field is an error, as in ANSI casts."""
    return F.split_part(residue_id, F.lit(":"), F.lit(3)).cast("bigint")


def coord_mask(coords: Column, fill_value: float | Column) -> Column:
    """Per atom: is it present, judged by its first coordinate."""
    fill = fill_value if isinstance(fill_value, Column) else F.lit(fill_value)
    return F.transform(coords, lambda atom: atom[0] != fill)


def pseudo_beta(coords: Column, residue_type: Column) -> Column:
    return F.when(residue_type == GLYCINE, coords[CA]).otherwise(coords[CB])


def pseudo_beta_mask(mask: Column, residue_type: Column) -> Column:
    return F.when(residue_type == GLYCINE, mask[CA]).otherwise(mask[CB])


def atom_or_nan(coords: Column, mask: Column, atom: int) -> Column:
    missing = F.array(*[F.lit(float("nan"))] * 3)
    return F.when(mask[atom], coords[atom]).otherwise(missing)


def backbone(coords: Column, mask: Column) -> Column:
    """CA, CB, N and C positions, with NaN where an atom is masked."""
    return F.struct(
        atom_or_nan(coords, mask, CA).alias("ca"),
        atom_or_nan(coords, mask, CB).alias("cb"),
        atom_or_nan(coords, mask, N).alias("n"),
        atom_or_nan(coords, mask, C).alias("c"),
    )
