"""Preference formatting with DataFrame functions alone.

Chosen and rejected conversations are compared turn by turn (role and text); the longest common turn
prefix is rendered once as the prompt, and what follows on either side is a completion whose mask lists
the character ranges of the assistant's turns, the only text to learn from.

Cases: turns are ordered by turn, role and text, so ties have one order; null roles and texts are empty
strings; a conversation without turns does not exist; when one side is a prefix of the other, its
completion is empty with an empty mask; equal sides give two empty completions. Rows with a null
conversation id form one conversation. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template, fixed values: opening of a turn, end of a turn.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id and its ordered turns (role, text)."""
    t = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(t))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _mask(turns: Column, role: str) -> Column:
    """Ranges first-end of the learned characters: text and end mark of the role's turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, x):
        head = F.length(x["role"]) + len(OPEN) + len(MIDDLE)
        end = acc["at"] + head + F.length(x["text"]) + len(CLOSE)
        own = F.array(F.concat_ws("-", (acc["at"] + head).cast("string"), end.cast("string")))
        return F.struct(end.alias("at"), F.when(x["role"] == role, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step)["spans"], ",")


def preference_format(pairs: DataFrame, role: str = "assistant") -> DataFrame:
    """``pairs`` has arrays ``chosen`` and ``rejected`` of (role, text); other columns are kept.

    Adds n_common, prompt, chosen_text, chosen_mask, rejected_text and rejected_mask.
    """
    c, r = F.col("chosen"), F.col("rejected")
    shorter = F.least(F.size(c), F.size(r))
    equal = F.transform(F.sequence(F.lit(1), shorter), lambda i: F.element_at(c, i) == F.element_at(r, i))
    differs = F.array_position(equal, False)
    counted = pairs.withColumn("n_common", F.when(shorter == 0, 0).when(differs == 0, shorter).otherwise(differs - 1).cast("int"))
    n = F.col("n_common")
    tail = lambda side: F.slice(side, n + 1, F.size(side))
    return counted.withColumns({
        "prompt": _text(F.slice(c, F.lit(1), n)), "chosen_text": _text(tail(c)), "chosen_mask": _mask(tail(c), role),
        "rejected_text": _text(tail(r)), "rejected_mask": _mask(tail(r), role),
    }).drop("chosen", "rejected")


def worse_ending(turns: Column, role: str = "assistant") -> Column:
    """The same conversation up to its last turn of ``role``, that turn answered with an earlier text: the
    role's first answer if there are two, else the turn before, else nothing."""
    own = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: F.element_at(turns, i)["role"] == role)
    last = F.element_at(own, -1)
    text = F.when(F.size(own) > 1, F.element_at(turns, F.element_at(own, 1))["text"]).when(last > 1, F.element_at(turns, last - 1)["text"]).otherwise("")
    swap = F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.when(F.size(own) > 0, F.concat(F.slice(turns, F.lit(1), last - 1), swap)).otherwise(F.slice(turns, F.lit(1), F.size(turns) - 1))


def pairs_of(turns: DataFrame) -> DataFrame:
    """One pair for each conversation. Conversations that open with the same turn share a chosen side, the
    smallest id; the others are rejected against it. A conversation alone (or the chosen one itself) is
    paired with its own worse ending. A group of any size gives as many pairs as it has conversations."""
    own = conversations(turns).withColumn("opening", F.sha2(rendered(F.element_at("turns", 1)), 256))
    leader = own.groupBy("opening").agg(F.min("conv_id").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("leader")
    led = own.join(leader, own["conv_id"] == leader["leader"]).select("opening", "leader", F.col("turns").alias("leader_turns"))
    both = own.join(led, "opening", "left")
    second = F.col("leader").isNotNull() & ~F.col("leader").eqNullSafe(F.col("conv_id"))
    return both.select(
        F.col("conv_id").alias("pair_id"), F.when(second, F.col("leader")).otherwise(F.col("conv_id")).alias("chosen_id"),
        F.when(second, F.col("leader_turns")).otherwise(F.col("turns")).alias("chosen"),
        F.when(second, F.col("turns")).otherwise(worse_ending(F.col("turns"))).alias("rejected"))
