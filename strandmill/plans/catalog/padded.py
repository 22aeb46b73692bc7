"""Padded training rows as text, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions.text import PAD
from strandmill.plans.catalog.tokens import _MODEL, _coded_sql, _ids_sql

_PAD_ID = _MODEL.ids[PAD]


def padded_sql(arranged: str, batch_size: int, key: str) -> str:
    """Padded ids, labels and masks, as text, of arranged rows with a column ``example``."""
    return f"""
    WITH t AS (
      SELECT {key}, example, example // {batch_size} AS batch_id, {_ids_sql('coded')} AS ids
      FROM (SELECT *, {_coded_sql('text')} AS coded FROM ({arranged}))),
    w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) - len(ids) AS fill FROM t)
    SELECT {key}, example, batch_id,
           array_to_string(list_concat(ids, list_transform(range(fill), lambda i: {_PAD_ID}::BIGINT)), ' ') AS input_ids,
           array_to_string(list_concat(ids, list_transform(range(fill), lambda i: -100::BIGINT)), ' ') AS labels,
           repeat('1', len(ids)) || repeat('0', fill) AS attention_mask FROM w
    """


def padded_text(batches):
    """Arrays of padded rows as text."""
    join = lambda name, sep: F.array_join(F.transform(name, lambda x: x.cast("string")), sep).alias(name)
    return batches.select(
        "id", "example", "batch_id", join("input_ids", " "), join("labels", " "), join("attention_mask", "")
    )
