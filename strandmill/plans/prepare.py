"""From corpus rows to training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.fim import (
    FIM_MIDDLE, FIM_RESERVE, WRAP_RESERVE, fim_apply, fim_flag, random_crop, wrap_tokens,
)
from strandmill.operators.bpe import BpeModel, tokenize
from strandmill.operators.labels import labels, sft_labels


def arrange_text(
    df: DataFrame, *, seed: int, max_length: int | None = None, fim_rate: float = 0.0,
    spm_rate: float = 0.5, generate: bool = False, text: str = "text", key: str = "id",
    batch_key: str | None = None,
) -> DataFrame:
    """Crop, rearrange and wrap; adds ``is_fim``. Column expressions only, batch or stream.

    Whether to rearrange is drawn per ``batch_key`` where given, else per row. The crop leaves
    room for the wrapping tokens, and for the tags of rows to be rearranged.
    """
    wanted = fim_flag(fim_rate, seed, batch_key or key)
    flagged = df.withColumn("_wanted", wanted)
    if max_length is not None:
        reserve = F.when(F.col("_wanted"), FIM_RESERVE).otherwise(WRAP_RESERVE)
        flagged = random_crop(flagged, F.lit(max_length) - reserve, seed, text, key)
    arranged = fim_apply(flagged, seed, spm_rate, F.col("_wanted"), text, key)
    return arranged.withColumn(text, wrap_tokens(F.col(text), add_eos=not generate)).drop("_wanted")


def encode_text(
    df: DataFrame, model: BpeModel, *, seed: int, bpe_dropout: float = 0.0,
    fim_sft_style: bool = False, generate: bool = False, text: str = "text", key: str = "id",
    prefix: str = "",
) -> DataFrame:
    """Token ids, mask, offsets and labels of wrapped texts, unpadded."""
    ids = F.col("input_ids")
    out = tokenize(df, model, text, key, bpe_dropout, seed)
    out = out.withColumn("attention_mask", F.transform(ids, lambda _: F.lit(1))).withColumn(
        "offset_mapping",
        F.zip_with("starts", "ends", lambda s, e: F.struct(s.alias("start"), e.alias("end"))),
    ).drop("starts", "ends")
    names = ["input_ids", "attention_mask", "offset_mapping"]
    if not generate:
        out = out.withColumn("labels", labels(ids, F.col("attention_mask")))
        if fim_sft_style:
            masked = sft_labels(F.col("labels"), model.ids[FIM_MIDDLE])
            out = out.withColumn("labels", F.when(F.col("is_fim"), masked).otherwise(F.col("labels")))
        names.append("labels")
    return out.withColumnsRenamed({n: f"{prefix}{n}" for n in names}) if prefix else out


def prepare_corpus(
    df: DataFrame, model: BpeModel, *, seed: int, max_length: int | None = None,
    fim_rate: float = 0.0, spm_rate: float = 0.5, fim_sft_style: bool = False,
    bpe_dropout: float = 0.0, generate: bool = False, text: str = "text", key: str = "id",
    batch_key: str | None = None, prefix: str = "",
) -> DataFrame:
    """The whole training transform: crop, rearrange, wrap, tokenize, label, flag. No shuffle."""
    arranged = arrange_text(
        df, seed=seed, max_length=max_length, fim_rate=fim_rate, spm_rate=spm_rate,
        generate=generate, text=text, key=key, batch_key=batch_key,
    )
    return encode_text(
        arranged, model, seed=seed, bpe_dropout=bpe_dropout, fim_sft_style=fim_sft_style,
        generate=generate, text=text, key=key, prefix=prefix,
    )
