"""Preference formatting: a shared prompt and a chosen and a rejected completion with masks.

The longest common prefix of turns of the two conversations is rendered once as the prompt.
The rest of each is rendered as a completion whose mask covers what an assistant says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def render_head(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))


def render_body(text: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def _render(turn: Column) -> Column:
    return F.concat(render_head(turn["role"]), render_body(turn["text"]))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """Half-open character spans of what is trained on, in order: assistants' text and its end."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        begin = acc["at"] + F.length(render_head(turn["role"]))
        stop = begin + F.length(render_body(turn["text"]))
        span = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
        spoken = F.coalesce(turn["role"] == TRAINED_ROLE, F.lit(False))
        spans = F.when(spoken, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(stop.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair: pair_id, n_prompt_turns, prompt, and text and mask of both completions.

    ``turns`` has pair_id, side ('chosen' or 'rejected'), turn, role and text; other columns are
    not looked at. Turns are ordered by number, then role and text; a repeated turn counts once.
    Rows without a pair_id, a turn number or a known side belong to no pair. Null roles and
    texts are equal to each other and are rendered as empty. A pair with one side only, or with
    equal sides, has an empty completion where nothing follows the prompt. A pair is one row of
    output, so one example must fit a row; pairs are spread by a hash of their id.
    """
    known = turns.where("pair_id is not null and turn is not null and side in ('chosen', 'rejected')")
    turn = F.struct("turn", "role", "text")
    sides = known.groupBy("pair_id").agg(*(
        F.array_sort(F.collect_set(F.when(F.col("side") == side, turn))).alias(side)
        for side in ("chosen", "rejected")
    ))
    same = F.zip_with(
        "chosen", "rejected",
        lambda a, b: a.isNotNull() & b.isNotNull()
        & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]),
    )
    first_other = F.array_position(same, False)
    n = F.when(first_other == 0, F.size(same)).otherwise(first_other - 1).cast("int")
    rest = {
        side: F.slice(F.col(side), F.col("n") + 1, F.size(side)) for side in ("chosen", "rejected")
    }
    return (
        sides.withColumn("n", n)
        .select(
            "pair_id", F.col("n").alias("n_prompt_turns"),
            F.slice("chosen", F.lit(1), F.col("n")).alias("shared"),
            *(turns_left.alias(side) for side, turns_left in rest.items()),
        )
        .select(
            "pair_id", "n_prompt_turns", _text(F.col("shared")).alias("prompt"),
            *(_text(F.col(side)).alias(side) for side in rest),
            *(_mask(F.col(side)).alias(f"{side}_mask") for side in rest),
        )
    )


def with_mask_text(pairs: DataFrame) -> DataFrame:
    """Masks as text: spans ``start-stop`` joined by commas."""
    text = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))
    ), ",")
    return pairs.withColumns({
        name: text(F.col(name)) for name in ("chosen_mask", "rejected_mask")
    })


def pairs_from_conversations(conversations: DataFrame) -> DataFrame:
    """Turns of preference pairs: each conversation is chosen over itself with another ending.

    The other ending is the last assistant turn of the conversation whose id differs in the
    lowest bit, put in place of the own last one. Without a partner that has one, nothing takes
    that place: the rejected side ends before it. A conversation without an assistant turn is both
    sides, whole. Every conversation with a numbered turn is one pair; rows without a conv_id or
    turn belong to none. Of several assistant turns with one number the one whose text sorts last
    is the last; all of them are replaced. Repeated rows count once when pairs are formed.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where(
        "conv_id is not null and turn is not null"
    )
    ends = (
        turns.where(F.col("role") == TRAINED_ROLE).groupBy("conv_id")
        .agg(F.max(F.struct("turn", "text")).alias("last"))
    )
    partners = ends.select(
        F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("other")
    )
    both = ends.select("conv_id", F.col("last.turn").alias("last_turn")).join(
        partners.withColumn("answered", F.lit(True)), "conv_id", "left"
    )
    joined = turns.join(both, "conv_id", "left")
    ending = F.coalesce((F.col("turn") == F.col("last_turn")) & (F.col("role") == TRAINED_ROLE), F.lit(False))
    columns = ["pair_id", "side", "turn", "role", "text"]
    chosen = joined.withColumns({"pair_id": F.col("conv_id"), "side": F.lit("chosen")})
    rejected = joined.where(F.expr("last_turn is null or turn <= last_turn")).where(
        ~ending | F.col("answered").isNotNull()
    ).withColumns({
        "pair_id": F.col("conv_id"), "side": F.lit("rejected"),
        "text": F.when(ending, F.col("other")).otherwise(F.col("text")),
    })
    return chosen.select(columns).unionByName(rejected.select(columns))
