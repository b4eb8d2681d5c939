"""Preference formatting of pairs of conversations.

Both conversations of a pair are put in order, their longest common prefix of turns is rendered once
as the prompt, and what follows on either side becomes a completion in parts, each with a flag that
says whether a model is to learn it: what the assistant says and its end mark, nothing else. All of
it is built of array functions; rows of one conversation meet once, and its length bounds the group.

Defined cases
- Turns are ordered by turn, then role, then text (nulls first); rows that repeat count once.
- null text: an empty turn. Null role: rendered as ``user``. Rows of null conv_id belong to no conversation.
- Equal conversations: all turns are prompt, both completions are empty. A pair that one side
  lacks: its rows are not used, as there is nothing to prefer.
- Empty table: no rows. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNT = "assistant"


def ordered_turns(turns: DataFrame, name: str) -> DataFrame:
    """(conv_id, ``name``): each conversation as an array of (turn, role, text) in order."""
    row = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(row)).alias(name))


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    """An array of turns as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit("<|end|>\n"))), "")


def parts(turns: Column) -> Column:
    """An array of turns as parts (text, learn): a learnt turn's header stands apart from what it says."""
    told = lambda text, learn: F.struct(text.alias("text"), F.lit(learn).alias("learn"))
    said = lambda t: F.concat(t["text"], F.lit("<|end|>\n"))
    each = lambda t: F.when(t["role"] == LEARNT, F.array(told(_header(t), False), told(said(t), True))).otherwise(F.array(told(F.concat(_header(t), said(t)), False)))
    return F.flatten(F.transform(turns, each))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(conv_id, n_common, prompt, chosen, rejected) for conversations in both tables (conv_id, turn, role, text).

    ``chosen`` and ``rejected`` are arrays of parts (text, learn)."""
    both = ordered_turns(chosen, "a").join(ordered_turns(rejected, "b"), "conv_id")
    # Turn numbers may differ between versions; a turn is the same if role and text are.
    same = F.zip_with("a", "b", lambda x, y: (x["role"].eqNullSafe(y["role"])) & (x["text"].eqNullSafe(y["text"])))
    first = F.array_position(same, False)
    both = both.withColumn("n_common", F.when(first == 0, F.size("a")).otherwise(first - 1).cast("int"))
    rest = lambda side: F.slice(F.col(side), F.col("n_common") + 1, F.size(side))
    return both.select(
        "conv_id", "n_common", rendered(F.slice("a", 1, F.col("n_common"))).alias("prompt"),
        parts(rest("a")).alias("chosen"), parts(rest("b")).alias("rejected"),
    )


def text_of(part_list: Column) -> Column:
    return F.array_join(F.transform(part_list, lambda p: p["text"]), "")


def mask_of(part_list: Column) -> Column:
    """The lengths of the parts in characters, each with 1 if it is learnt: ``13:0,120:1``."""
    return F.array_join(F.transform(part_list, lambda p: F.concat_ws(":", F.length(p["text"]), F.when(p["learn"], "1").otherwise("0"))), ",")


def swapped_answers(turns: DataFrame) -> DataFrame:
    """A rejected version of each conversation: its last answer is that of its neighbour (conv_id with the
    lowest bit turned), or missing where there is no neighbour that answers."""
    last = turns.where(F.col("role") == LEARNT).where("conv_id is not null").groupBy("conv_id")
    last = last.agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last")).select("conv_id", "last.turn", "last.text")
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("text").alias("other"))
    last = last.withColumnRenamed("text", "mine").withColumnRenamed("turn", "last_turn").join(other, "conv_id", "left")
    rows = turns.select("conv_id", "turn", "role", "text").join(last, "conv_id", "left")
    is_last = F.coalesce((F.col("role") == LEARNT) & F.col("turn").eqNullSafe(F.col("last_turn")) & (F.coalesce("text", F.lit("")) == F.col("mine")), F.lit(False))
    rows = rows.where(~is_last | F.col("other").isNotNull())
    return rows.select("conv_id", "turn", "role", F.when(is_last, F.col("other")).otherwise(F.col("text")).alias("text"))
