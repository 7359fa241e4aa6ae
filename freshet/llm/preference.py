"""Preference pairs of conversations: the common start once as prompt, two completions with masks.

``turns`` holds one row per turn, ``pairs`` names a chosen and a rejected conversation.  The longest
common turn prefix ends at the first turn number where the two differ: turns are counted by (pair,
turn, role, text) on either side, and the smallest turn with unequal counts is the cut, so neither
windows nor sorted lists are needed to find it.  Turns before the cut are rendered once, as the
prompt; the others become the two completions.  A mask lists the character ranges of a completion
to train on: the text and end mark of turns whose role is trained.

All of it is DataFrame code with one join and two aggregations by pair.  One output row is as long as
its two conversations, as a document is as long as its text; a conversation that occurs in very many
pairs makes as many output rows, and the join that feeds them may be split by Spark.

Defined cases: null roles and texts are rendered as empty; turns without a number come last; turns
with equal numbers are ordered by role and text; a conversation that is missing has no turns, its
completion is null; identical conversations have two empty completions (``tied``); repeated pairs
give repeated rows; other columns of ``turns`` are not kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks around a rendered turn.
OPEN, AFTER_ROLE, CLOSE, END = "<|im_start|>", "\n", "<|im_end|>", "\n"
LAST = (1 << 63) - 1


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(AFTER_ROLE), text, F.lit(CLOSE + END))


def _joined(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["shown"]), "")


def _mask(segments: Column, trained: Sequence[str]) -> Column:
    """Character ranges ``start`` (from 0) to ``end`` (exclusive) of the trained parts of a completion."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, s):
        start = acc["at"] + len(OPEN + AFTER_ROLE) + F.length(s["role"])
        span = F.struct(start.alias("start"), (acc["at"] + F.length(s["shown"]) - len(END)).alias("end"))
        return F.struct(
            (acc["at"] + F.length(s["shown"])).alias("at"),
            F.when(s["role"].isin(list(trained)), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(segments, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def format_pairs(turns: DataFrame, pairs: DataFrame, trained: Sequence[str] = ("assistant",), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per row of ``pairs`` (``pair_id, chosen_id, rejected_id``; ids of pairs are distinct or their rows equal).

    Adds ``n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, tied``.
    """
    asked = pairs.groupBy("pair_id", "chosen_id", "rejected_id").agg(F.count("*").alias("copies"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("conv")), F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("conv"))))
    links = asked.select("pair_id", sides.alias("s")).select("pair_id", "s.side", "s.conv").where("conv IS NOT NULL")
    said = turns.select(
        F.col(conv).alias("conv"), F.coalesce(F.col(turn).cast("bigint"), F.lit(LAST)).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    side = lambda k: F.count_if(F.col("side") == k)
    met = links.join(said, "conv").groupBy("pair_id", "turn", "role", "text").agg(side(0).alias("n_chosen"), side(1).alias("n_rejected"))
    segment = F.struct("turn", "role", "text", "n_chosen", "n_rejected")
    records = met.groupBy("pair_id").agg(
        F.min(F.when(F.col("n_chosen") != F.col("n_rejected"), F.col("turn"))).alias("cut"), F.array_sort(F.collect_list(segment)).alias("all"),
        F.max("n_chosen").alias("any_chosen"), F.max("n_rejected").alias("any_rejected"),
    )

    def shown(keep, count):
        """Rendered turns that ``keep`` selects, each as often as it was said."""
        kept = F.filter("all", keep)
        return F.flatten(F.transform(kept, lambda s: F.array_repeat(F.struct(s["role"].alias("role"), render(s["role"], s["text"]).alias("shown")), s[count].cast("int"))))

    in_prompt = lambda s: F.col("cut").isNull() | (s["turn"] < F.col("cut"))
    cut = records.select(
        "pair_id", "any_chosen", "any_rejected", shown(in_prompt, "n_chosen").alias("_prompt"),
        shown(lambda s: ~in_prompt(s), "n_chosen").alias("_chosen"), shown(lambda s: ~in_prompt(s), "n_rejected").alias("_rejected"),
    )
    done = cut.select(
        "pair_id", F.size("_prompt").cast("long").alias("n_prompt_turns"), _joined(F.col("_prompt")).alias("prompt"),
        F.when(F.col("any_chosen") > 0, _joined(F.col("_chosen"))).alias("chosen"), _mask(F.col("_chosen"), trained).alias("chosen_mask"),
        F.when(F.col("any_rejected") > 0, _joined(F.col("_rejected"))).alias("rejected"), _mask(F.col("_rejected"), trained).alias("rejected_mask"),
        ((F.size("_chosen") == 0) & (F.size("_rejected") == 0)).alias("tied"),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = asked.join(done, "pair_id", "left").withColumns({
        "n_prompt_turns": F.coalesce("n_prompt_turns", F.lit(0)), "prompt": F.coalesce("prompt", F.lit("")), "tied": F.coalesce("tied", F.lit(True)),
        "chosen_mask": F.coalesce("chosen_mask", none), "rejected_mask": F.coalesce("rejected_mask", none),
    })
    return whole.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy", "copies")


def neighbour_pairs(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as pair k."""
    k = F.shiftright(F.col(conv).cast("bigint"), 1)
    return turns.where(F.col(conv).isNotNull()).select(k.alias("pair_id")).distinct().select("pair_id", (2 * F.col("pair_id")).alias("chosen_id"), (2 * F.col("pair_id") + 1).alias("rejected_id"))
