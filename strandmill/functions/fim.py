"""Crop, fill-in-the-middle rearrangement, wrapping, and the inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.keyed import randint, uniform
from strandmill.functions.text import BOS, EOS

# The three tags of a rearranged text.
FIM_PREFIX = "<fim_prefix>"
FIM_SUFFIX = "<fim_suffix>"
FIM_MIDDLE = "<fim_middle>"
FIM_TAGS = (FIM_PREFIX, FIM_SUFFIX, FIM_MIDDLE)
_ANY_TAG = "|".join(FIM_TAGS)

# Tokens that wrapping (2) and the tags (3) add to a cropped text.
WRAP_RESERVE = 2
FIM_RESERVE = 5


def random_crop(
    df: DataFrame, max_length: int | Column | None, seed: int,
    text: str = "text", key: str = "id",
) -> DataFrame:
    """Keep ``max_length`` characters from a uniform start; shorter texts stay whole.

    ``None`` and 0 switch the crop off. A column gives each row its own limit.
    """
    if max_length is None:
        return df
    limit = max_length if isinstance(max_length, Column) else F.lit(max_length)
    n = F.length(text)
    start = randint(uniform(seed, "crop", key), F.lit(0), n - limit)
    cropped = F.substring(F.col(text), start + F.lit(1), limit)
    return df.withColumn(text, F.when((limit != 0) & (limit < n), cropped).otherwise(F.col(text)))


def fim_flag(fim_rate: float, seed: int, key: str = "id") -> Column:
    """Whether a row (or, with a batch key, its whole batch) is rearranged."""
    return uniform(seed, "fim", key) < F.lit(float(fim_rate))


def rearranged(text: Column, cut1: Column, cut2: Column, is_spm: Column) -> Column:
    """The text cut at two places and put in SPM or PSM order, middle last."""
    prefix = F.substring(text, F.lit(1), cut1)
    middle = F.substring(text, cut1 + F.lit(1), cut2 - cut1)
    suffix = F.substring(text, cut2 + F.lit(1), F.length(text) - cut2)
    spm = [F.lit(FIM_SUFFIX), suffix, F.lit(FIM_PREFIX), prefix]
    psm = [F.lit(FIM_PREFIX), prefix, F.lit(FIM_SUFFIX), suffix]
    tail = [F.lit(FIM_MIDDLE), middle]
    return F.when(is_spm, F.concat(*spm, *tail)).otherwise(F.concat(*psm, *tail))


def fim_apply(
    df: DataFrame, seed: int, spm_rate: float = 0.5, apply: Column | None = None,
    text: str = "text", key: str = "id",
) -> DataFrame:
    """Rearrange rows where ``apply`` holds and set ``is_fim``.

    The first cut leaves at least one character for the middle; empty texts pass unchanged.
    """
    n = F.length(text)
    wanted = F.lit(True) if apply is None else apply
    return (
        df.withColumn("is_fim", wanted & (n > 0))
        .withColumn("_cut1", randint(uniform(seed, "cut1", key), F.lit(0), n - F.lit(1)))
        .withColumn("_cut2", randint(uniform(seed, "cut2", key), F.col("_cut1") + F.lit(1), n))
        .withColumn("_spm", uniform(seed, "spm", key) < F.lit(float(spm_rate)))
        .withColumn(
            text,
            F.when(
                F.col("is_fim"),
                rearranged(F.col(text), F.col("_cut1"), F.col("_cut2"), F.col("_spm")),
            ).otherwise(F.col(text)),
        )
        .drop("_cut1", "_cut2", "_spm")
    )


def wrap_tokens(text: Column, add_eos: bool = True) -> Column:
    parts = [F.lit(BOS), text]
    return F.concat(*parts, F.lit(EOS)) if add_eos else F.concat(*parts)


def defim_reconstruct(text: Column) -> Column:
    """Undo the rearrangement: prefix, middle, suffix. Text before any tag counts as prefix."""
    segments = F.split(text, f"(?={_ANY_TAG})")

    def section(tag: str) -> Column:
        others = [t for t in FIM_TAGS if t != tag]
        mine = F.filter(
            segments,
            (lambda s: ~s.startswith(others[0]) & ~s.startswith(others[1]))
            if tag == FIM_PREFIX
            else (lambda s: s.startswith(tag)),
        )
        return F.replace(F.array_join(mine, ""), F.lit(tag), F.lit(""))

    return F.concat(section(FIM_PREFIX), section(FIM_MIDDLE), section(FIM_SUFFIX))


def defim_strip(text: Column) -> Column:
    """Remove the tags and keep the order the text is in."""
    return F.regexp_replace(text, _ANY_TAG, "")
