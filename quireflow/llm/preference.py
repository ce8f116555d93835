"""Preference formatting of chosen and rejected conversations, in DataFrame operations only.

The longest common prefix of turns is rendered once as the prompt; what
remains of each conversation is its completion, with the spans of assistant
text as the mask of what a trainer learns from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.columns import let, running


def _opening(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.translate(turn["role"], "|", "¦"), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    """A turn's text; what would read as the start of a marker gets a second bar, so that only real turns open with one."""
    return F.replace(turn["text"], F.lit("<|"), F.lit("<||"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_opening(t), _body(t), F.lit("\n"))), "")


def _mask(turns: Column, learn: str) -> Column:
    """[(start, end)] in code points of the text of each turn of role ``learn``, within _render(turns)."""
    sizes = F.transform(turns, lambda t: F.struct(F.length(_opening(t)).alias("open"), F.length(_body(t)).alias("body"), (t["role"] == learn).alias("learn")))

    def spans(each: Column) -> Column:
        before = running(F.transform(each, lambda x: (x["open"] + x["body"] + 1).cast("long")))
        placed = F.zip_with(each, before, lambda x, at: F.struct((at + x["open"]).alias("start"), (at + x["open"] + x["body"]).alias("end"), x["learn"].alias("learn")))
        return F.transform(F.filter(placed, lambda x: x["learn"]), lambda x: F.struct(x["start"], x["end"]))

    return let(sizes, spans)


def format_pairs(conversations: DataFrame, pairs: DataFrame, learn: str = "assistant") -> DataFrame:
    """chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask for each row of ``pairs``.

    ``conversations`` holds conv_id, turn, role, text; turns are ordered by
    turn, then role, then text, so ties and repeated rows have one order. A
    null role is "unknown", a null text empty, a null turn comes first; rows
    without a conv_id belong to no conversation. An id of ``pairs`` that is
    null or unknown stands for an empty conversation. If one conversation is a
    prefix of the other, its completion is empty. A text that holds "<|" is
    written with "<||" there, a bar in a role as "¦", so no text can pass for a
    turn of its own. Other columns are not read.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.where("conv_id IS NOT NULL").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    c = whole.select(F.col("conv_id").alias("_q_c"), F.col("turns").alias("c"))
    r = whole.select(F.col("conv_id").alias("_q_r"), F.col("turns").alias("r"))
    both = pairs.select("chosen_id", "rejected_id").join(c, F.col("chosen_id") == F.col("_q_c"), "left").join(r, F.col("rejected_id") == F.col("_q_r"), "left")
    both = both.select("chosen_id", "rejected_id", F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, False).cast("int")
    n = F.when(differs > 0, differs - 1).otherwise(F.size(same))
    both = both.withColumn("n", n)
    both = both.select("*", F.slice("c", 1, F.col("n")).alias("p"), F.slice("c", F.col("n") + 1, F.size("c")).alias("cc"), F.slice("r", F.col("n") + 1, F.size("r")).alias("rr"))
    return both.select(
        "chosen_id",
        "rejected_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("cc")).alias("chosen"),
        _render(F.col("rr")).alias("rejected"),
        _mask(F.col("cc"), learn).alias("chosen_mask"),
        _mask(F.col("rr"), learn).alias("rejected_mask"),
    )


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): conversations 2k and 2k + 1; the other is null where one is missing."""
    ids = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("i"))
    even = F.pmod("i", F.lit(2)) == 0
    return ids.groupBy(F.shiftright("i", 1).alias("k")).agg(F.max(F.when(even, F.col("i"))).alias("chosen_id"), F.max(F.when(~even, F.col("i"))).alias("rejected_id")).drop("k")
