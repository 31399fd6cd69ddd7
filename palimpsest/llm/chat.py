"""Preference formatting with DataFrame functions only.

A preference pair is two conversations, chosen and rejected. Their longest common prefix of turns
is rendered once as the prompt; what follows on each side is rendered as a completion with the
character spans that carry loss (assistant text and its closing mark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id and its turns as array<struct<role, text>> in order.

    Turns are ordered by number (null first), then role and text, so ties and repeated rows have a
    fixed place. A null role is `user`, a null text empty. Rows with a null id are one conversation.
    """
    said = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("user")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    turns_of = F.transform(F.sort_array(F.collect_list(said)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.groupBy(F.col(id_col).alias("conv_id")).agg(turns_of.alias("turns"))


def last_reply(turns: Column) -> Column:
    """1-based place of the last assistant turn; 0 if there is none."""
    return F.array_size(turns) + 1 - F.greatest(F.lit(1), F.coalesce(F.nullif(F.array_position(F.reverse(F.transform(turns, lambda t: t["role"])), F.lit("assistant")), F.lit(0)), F.array_size(turns) + 1))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def loss_spans(turns: Column) -> Column:
    """array<struct<start, length>>: characters of render(turns) that carry loss, in order."""
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(rendered(t))).alias("at"),
        F.when(
            t["role"] == "assistant",
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(F.lit(OPEN)) + F.length(t["role"]) + 1).alias("start"), (F.length(t["text"]) + F.length(F.lit(CLOSE))).alias("length")))),
        ).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns at the start of a and b that agree in role and text."""
    both = F.least(F.array_size(a), F.array_size(b))
    differs = F.transform(F.arrays_zip(F.slice(a, F.lit(1), both).alias("a"), F.slice(b, F.lit(1), both).alias("b")), lambda x: x["a"] != x["b"])
    at = F.array_position(differs, F.lit(True))
    return F.when(at == 0, both).otherwise(at - 1).cast("int")


def format_preferences(pairs: DataFrame, *, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """pairs (two columns of array<struct<role, text>>) with n_prompt_turns, prompt, and per side a
    completion and its loss spans; the two columns are replaced by the completions' text.

    A null side is an empty conversation. If both sides agree wholly, or one is a prefix of the
    other, the prompt is all that agrees and the shorter side's completion is empty, without loss.
    Row by row: no shuffle, other columns stay.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    chosen, rejected = F.coalesce(F.col(chosen_col), empty), F.coalesce(F.col(rejected_col), empty)
    rest = lambda side: F.slice(side, F.col("n_prompt_turns") + 1, F.array_size(side))
    out = pairs.withColumn("n_prompt_turns", common_turns(chosen, rejected))
    out = out.withColumn("prompt", render(F.slice(chosen, F.lit(1), F.col("n_prompt_turns"))))
    out = out.withColumn("chosen_loss", loss_spans(rest(chosen))).withColumn("rejected_loss", loss_spans(rest(rejected)))
    return out.withColumns({chosen_col: render(rest(chosen)), rejected_col: render(rest(rejected))})


def reply_swaps(convs: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: each one against itself with another's last reply.

    The conversation with the same id but for the lowest bit lends its last assistant turn; the
    rejected side is what comes before the own last assistant turn, then the lent one. Without a
    partner or without a reply there, the rejected side ends before the reply; without an own
    reply the lent one follows all turns. A null id has no partner.
    """
    place = last_reply(F.col("turns"))
    lent = convs.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("_to"), F.when(place > 0, F.slice("turns", place, F.lit(1))).alias("_lent"))
    empty = F.array().cast("array<struct<role:string,text:string>>")
    before = F.when(place > 0, F.slice("turns", F.lit(1), place - 1)).otherwise(F.col("turns"))
    met = convs.join(lent, convs["conv_id"] == lent["_to"], "left")
    return met.select("conv_id", F.col("turns").alias("chosen"), F.concat(before, F.coalesce("_lent", empty)).alias("rejected"))
