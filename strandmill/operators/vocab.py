"""Vocabularies as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.functions.fim import FIM_TAGS
from strandmill.operators.rowid import with_row_id


def ranked_vocab(tokens: DataFrame, specials: Sequence[str]) -> DataFrame:
    """Special tokens first, then the distinct tokens by falling frequency, then by name."""
    spark = tokens.sparkSession
    counts = tokens.filter(~F.col("token").isin(*specials)).groupBy("token").agg(
        (-F.count(F.lit(1))).alias("_falling")
    )
    ranked = with_row_id(counts, ["_falling", "token"], out="_rank").select(
        "token", (F.col("_rank") + F.lit(len(specials))).cast("int").alias("token_id")
    )
    first = spark.createDataFrame(
        [(t, i) for i, t in enumerate(specials)], "token string, token_id int"
    )
    return first.unionByName(ranked)


def vocab_extend(vocab: DataFrame, extra: Sequence[str] = FIM_TAGS) -> DataFrame:
    """Append special tokens after the highest id; tokens already there keep theirs."""
    spark = vocab.sparkSession
    known = {r["token"] for r in vocab.filter(F.col("token").isin(*extra)).select("token").collect()}
    top = vocab.agg(F.max("token_id")).first()[0]
    next_id = 0 if top is None else top + 1
    new = [t for t in extra if t not in known]
    if not new:
        return vocab
    rows = [(t, next_id + k) for k, t in enumerate(new)]
    return vocab.unionByName(spark.createDataFrame(rows, "token string, token_id int"))


def vocab_suppress(vocab: DataFrame, part: str = "X") -> DataFrame:
    """Tokens that contain ``part`` and are not bracketed."""
    return vocab.filter(F.col("token").contains(part) & ~F.col("token").startswith("["))


def max_token_chars(vocab: DataFrame, specials: Sequence[str]) -> DataFrame:
    """Length of the longest token that is not special."""
    return vocab.filter(~F.col("token").isin(*specials)).agg(
        F.max(F.length("token")).alias("max_token_chars")
    )
