"""Crop, rearrangement, wrapping, the inverse, and clean-up of decoded text."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions.fim import (
    FIM_MIDDLE, defim_reconstruct, defim_strip, fim_apply, random_crop, wrap_tokens,
)
from strandmill.functions.text import clean_decoded
from strandmill.plans.catalog.registry import (
    DOCS_SQL, SEED, docs, query, sql_arranged, sql_randint, sql_uniform,
)

CROP = 200
SPM_RATE = 0.5
_FIM_SQL = sql_arranged(DOCS_SQL, SPM_RATE)
_START = sql_randint(sql_uniform("crop", "id"), "0", f"length(text) - {CROP}")


@query("random_crop", f"""
    SELECT id, CASE WHEN {CROP} < length(text) THEN substr(text, {_START} + 1, {CROP}) ELSE text END AS text
    FROM ({DOCS_SQL})
""")
def random_crop_query(spark, sf_dir):
    return random_crop(docs(spark, sf_dir), CROP, SEED)


@query("fim_apply", f"SELECT id, text, is_fim FROM ({_FIM_SQL})")
def fim_apply_query(spark, sf_dir):
    return fim_apply(docs(spark, sf_dir), SEED, SPM_RATE)


@query("wrap_bos_eos", f"""
    SELECT id, '[BOS]' || text || '[EOS]' AS training, '[BOS]' || text AS prompt FROM ({DOCS_SQL})
""")
def wrap_bos_eos(spark, sf_dir):
    return docs(spark, sf_dir).select(
        "id", wrap_tokens(F.col("text")).alias("training"),
        wrap_tokens(F.col("text"), add_eos=False).alias("prompt"),
    )


@query("defim_reconstruct", f"""
    SELECT id, 'QQ' || prefix || middle || id || suffix AS text FROM ({_FIM_SQL})
""")
def defim_reconstruct_query(spark, sf_dir):
    """Text before the first tag, and a second middle part, both have to find their place."""
    arranged = fim_apply(docs(spark, sf_dir), SEED, SPM_RATE)
    marked = F.concat(F.lit("QQ"), "text", F.lit(FIM_MIDDLE), "id")
    return arranged.select("id", defim_reconstruct(marked).alias("text"))


@query("defim_strip", f"""
    SELECT id, CASE WHEN spm THEN suffix || prefix ELSE prefix || suffix END || middle AS text
    FROM ({_FIM_SQL})
""")
def defim_strip_query(spark, sf_dir):
    arranged = fim_apply(docs(spark, sf_dir), SEED, SPM_RATE)
    return arranged.select("id", defim_strip(F.col("text")).alias("text"))


@query("clean_decoded", f"""
    SELECT id, replace(text, ' ', '') || '[UNK]<fim_middle>' AS text FROM ({DOCS_SQL})
""")
def clean_decoded_query(spark, sf_dir):
    decoded = F.concat(
        F.lit("[BOS] "), "text", F.lit("[UN[UNK]K] <fim_middle> [EOS]"), F.repeat(F.lit("[PAD]"), F.lit(3))
    )
    # One removal does not open the next of the same token: the split unknown stays behind.
    return docs(spark, sf_dir).select("id", clean_decoded(decoded).alias("text"))
