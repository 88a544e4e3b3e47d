"""Preference formatting of chat conversations, by DataFrame expressions only.

Chosen and rejected conversations of a pair are compared turn by turn. Their longest common prefix
of turns is rendered once as the prompt; the rest of each is rendered as its completion, in
segments of which only those by the assistant are trained on. Masks are spans of code points.

A conversation is the unit of output and is held in one row, as its rendering is one text.

Defined results: turns are ordered by turn, role and text, nulls first, and repeated turns are kept;
null text renders as empty and a null role as ``unknown``; turns are common if role and text are
equal, two nulls being equal; a conversation without its partner gives an empty other side and
``paired`` false; rows with a null conv_id are no conversation; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns from the start are equal in both."""
    n = F.least(F.size(chosen), F.size(rejected))
    same = F.zip_with(F.slice(chosen, 1, n), F.slice(rejected, 1, n), lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first_other = F.array_position(same, False)
    return F.when(first_other == 0, n).otherwise(first_other.cast("int") - 1)


def rendered(turn: Column) -> Column:
    """One turn as text."""
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("unknown")), F.lit(MIDDLE), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def trained_spans(turns: Column) -> Column:
    """The spans (start, end) of a rendered completion that the assistant wrote, with their closing marks."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        head = F.length(F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("unknown")), F.lit(MIDDLE))).cast("long")
        end = acc["at"] + F.length(rendered(turn)).cast("long")
        span = F.struct((acc["at"] + head).alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(turn["role"] == TRAINED, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def preferences(pairs: DataFrame) -> DataFrame:
    """From pair_id, chosen and rejected (arrays of turns, or null) the prompt and the masked completions."""
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    sides = pairs.select("pair_id", F.col("chosen").isNotNull().alias("_c"), F.col("rejected").isNotNull().alias("_r"), F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    split = sides.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    tails = split.withColumns({"prompt": joined(F.slice("chosen", F.lit(1), F.col("prompt_turns"))), "chosen": rest("chosen"), "rejected": rest("rejected")})
    return tails.select(
        "pair_id", (F.col("_c") & F.col("_r")).alias("paired"), F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt",
        joined(F.col("chosen")).alias("chosen"), trained_spans(F.col("chosen")).alias("chosen_mask"),
        joined(F.col("rejected")).alias("rejected"), trained_spans(F.col("rejected")).alias("rejected_mask"),
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of the conversations 2k (chosen) and 2k + 1 (rejected), their turns in order."""
    other = F.pmod(F.col("conv_id"), F.lit(2))
    known = turns.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    rows = known.where("conv_id is not null").select((F.col("conv_id") - other).alias("pair_id"), other.alias("other"), "t")
    side = lambda k: F.sort_array(F.collect_list(F.when(F.col("other") == k, F.col("t"))))
    both = rows.groupBy("pair_id").agg(side(0).alias("chosen"), side(1).alias("rejected"))
    return both.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in ("chosen", "rejected")})


def _last(turns: Column) -> Column:
    """The place from 1 of the last turn of the assistant, 0 if there is none."""
    at = F.array_position(F.reverse(F.transform(turns, lambda t: F.coalesce(t["role"] == TRAINED, F.lit(False)))), True)
    return F.coalesce(F.when(at > 0, F.size(turns) - at + 1), F.lit(0)).cast("int")


def replies(turns: DataFrame) -> DataFrame:
    """For every conversation its own last reply (chosen) against that of the neighbouring conversation (rejected).

    Both sides have the turns before that reply; later turns go. Conversations 2k and 2k + 1 are
    neighbours. Without a reply of its own a conversation is whole, and there is no rejected side
    unless both have one.
    """
    both = neighbours(turns).withColumns({"_c": _last(F.col("chosen")), "_r": _last(F.col("rejected"))})

    def side(conv_id: Column, own: str, at: str, other: str, other_at: str) -> Column:
        before = F.slice(own, F.lit(1), F.greatest(F.col(at) - 1, F.lit(0)))
        chosen = F.when(F.col(at) > 0, F.slice(own, F.lit(1), F.greatest(F.col(at), F.lit(1)))).otherwise(F.col(own))
        rejected = F.when((F.col(at) > 0) & (F.col(other_at) > 0), F.concat(before, F.slice(other, F.greatest(F.col(other_at), F.lit(1)), F.lit(1))))
        return F.struct(conv_id.alias("pair_id"), chosen.alias("chosen"), rejected.alias("rejected"))

    sides = F.array(side(F.col("pair_id"), "chosen", "_c", "rejected", "_r"), side(F.col("pair_id") + 1, "rejected", "_r", "chosen", "_c"))
    return both.select(F.inline(sides)).where("chosen is not null")


def masked(mask: str) -> Column:
    """A mask as text, ``start-end`` joined by commas."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
