"""Preference formatting: chosen and rejected conversations with their common beginning rendered once as the prompt.

Only built-in functions. Both conversations of a pair are laid side by side by turn; the first turn at which they differ
ends the prompt. A conversation of any length is given in parts of a fixed number of turns, so that no row and no group
grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.llm.store import SMALL_ROWS, written

# Turns of a part.
PART_TURNS = 64

# The role whose text is to be learnt.
ANSWERS = "assistant"


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))


def body(text: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def _messages(side: str, every: bool) -> Column:
    """One side's messages of a turn by role and text: all, or the first alone."""
    message = F.when(F.col("side") == side, F.struct(F.col("role"), F.col("text")))
    if every:
        return F.array_sort(F.collect_list(message)).alias(side)
    return F.filter(F.array(F.min(message)), lambda m: m.isNotNull()).alias(side)


def _rendered(side: str, inside: Column) -> Column:
    """The rendered messages of one side in the part, in order, and which characters of them are to be learnt."""
    there = F.flatten(F.transform(F.filter(F.col("turns"), inside), lambda t: t[side]))
    return F.transform(there, lambda m: F.struct(head(m["role"]).alias("head"), body(m["text"]).alias("body"), m["role"].alias("role")))


def _text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["head"], m["body"])), "")


def _spans(messages: Column) -> Column:
    """``start+length`` of each answer in the text of the part, joined by commas: the unmasked characters."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.char_length(m["head"])
        span = F.concat(begin.cast("string"), F.lit("+"), F.char_length(m["body"]).cast("string"))
        known = F.when(acc["spans"] == "", span).otherwise(F.concat(acc["spans"], F.lit(","), span))
        spans = F.when(m["role"].eqNullSafe(F.lit(ANSWERS)), known).otherwise(acc["spans"])
        return F.struct((begin + F.char_length(m["body"])).alias("at"), spans.alias("spans"))

    return F.aggregate(messages, start, step)["spans"]


def format_preferences(turns: DataFrame, every_message: bool = False) -> DataFrame:
    """Pairs from ``pair_id, side, turn, role, text``, side being chosen or rejected.

    A row per pair and part of 64 turns: ``pair_id, part, prompt_turns, prompt, chosen, chosen_spans, rejected,
    rejected_spans``. The prompt has the turns before the first one that differs in role or text or that one side
    lacks; completions have the turns from there. Spans are the characters of a completion's part to be learnt: text
    and end mark of answers; all else, and the whole prompt, is masked. Null texts and roles count as empty in what is
    rendered and differ from empty ones in the comparison; a null turn comes first. With ``every_message`` all messages
    of a turn are kept, by role and text, are compared as a whole and count each in ``prompt_turns``; a part then grows
    with the messages of its turns. Without it one side has one message per turn, of several the first by role and
    text. Other columns are left out; no rows give no rows.
    """
    numbered = turns.where(F.col("side").isin("chosen", "rejected")).select(
        "pair_id", "side", F.coalesce(F.col("turn").cast("bigint"), F.lit(-1).cast("bigint")).alias("turn"), "role", "text"
    )
    aligned = written(numbered.groupBy("pair_id", "turn").agg(_messages("chosen", every_message), _messages("rejected", every_message)), "aligned-turns")
    differs = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    splits = written(
        aligned.groupBy("pair_id").agg(
            F.min(F.when(differs, F.col("turn"))).alias("split"),
        ),
        "pair-splits",
    )
    small = splits.count() <= SMALL_ROWS
    placed = aligned.join(F.broadcast(splits) if small else splits, aligned.pair_id.eqNullSafe(splits.pair_id)).drop(splits.pair_id)
    before = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    part = F.floor(F.col("turn") / PART_TURNS).cast("bigint")
    grouped = placed.withColumn("part", part).groupBy("pair_id", "part").agg(
        F.first("split").alias("split"), F.array_sort(F.collect_list(F.struct("turn", before.alias("common"), "chosen", "rejected"))).alias("turns")
    )
    prompt = _rendered("chosen", lambda t: t["common"])
    chosen = _rendered("chosen", lambda t: ~t["common"])
    rejected = _rendered("rejected", lambda t: ~t["common"])
    common = F.size(F.flatten(F.transform(F.filter(F.col("turns"), lambda t: t["common"]), lambda t: t["chosen"])))
    return grouped.select(
        "pair_id",
        "part",
        common.cast("bigint").alias("prompt_turns"),
        _text(prompt).alias("prompt"),
        _text(chosen).alias("chosen"),
        _spans(chosen).alias("chosen_spans"),
        _text(rejected).alias("rejected"),
        _spans(rejected).alias("rejected_spans"),
    )


def repeated_answer_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: chosen as they are up to their last answer, rejected with the answer before it.

    An assistant that says again what it said before is a natural thing to reject. Where there is no earlier answer the
    rejected one is empty; a conversation without any answer has no pair.
    """
    turn = F.coalesce(F.col("turn").cast("bigint"), F.lit(-1).cast("bigint"))
    said = conversations.select(F.col("conv_id").alias("pair_id"), turn.alias("turn"), "role", "text")
    answers = said.where(F.col("role") == ANSWERS)
    last = written(answers.groupBy("pair_id").agg(F.max("turn").alias("last")), "last-answers")
    same = answers.join(last.withColumnRenamed("pair_id", "_pair"), F.col("pair_id").eqNullSafe(F.col("_pair")))
    earlier = same.where("turn < last").groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("old"))
    known = earlier.select(F.col("pair_id").alias("_old_pair"), F.coalesce(F.col("old.text"), F.lit("")).alias("old"))
    ends = written(
        last.join(known, F.col("pair_id").eqNullSafe(F.col("_old_pair")), "left").select(
            F.col("pair_id").alias("_pair"), "last", F.coalesce("old", F.lit("")).alias("old")
        ),
        "answer-ends",
    )
    small = ends.count() <= SMALL_ROWS
    kept = said.join(F.broadcast(ends) if small else ends, F.col("pair_id").eqNullSafe(F.col("_pair"))).where("turn <= last")
    # Of several messages of the last turn all that are answers are replaced.
    replaced = (F.col("turn") == F.col("last")) & (F.col("role") == ANSWERS)
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("said")),
        F.struct(F.lit("rejected").alias("side"), F.when(replaced, F.col("old")).otherwise(F.col("text")).alias("said")),
    )
    return kept.select("pair_id", "turn", "role", F.explode(sides).alias("s")).select("pair_id", "s.side", "turn", "role", F.col("s.said").alias("text"))
