"""Conversations in batch: score traces, first distress, intents, slots and speaker changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text as T


def score_trace(turns: DataFrame, positives, negatives=(), joint: str = "\n") -> DataFrame:
    """The score of everything the user has said so far, joined, at each of the user's turns.

    Only term hits are carried along, never the growing text: a term that was said stays said. For terms
    that span utterances each turn is looked at with what was said before it, as far back as the longest
    term reaches.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    w = by_turn.rowsBetween(Window.unboundedPreceding, 0)
    reach = max((len(t) for t in (*positives, *negatives)), default=1) - 1
    said = turns.filter("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    if reach:
        # Each utterance adds a character at least; without anything between them, empty ones stay out.
        near = by_turn if joint else Window.partitionBy("conv_id", F.col("text") == "").orderBy("turn")
        ends = F.collect_list(F.right("text", F.lit(reach))).over(near.rowsBetween(-reach, -1))
        tail = F.when(F.row_number().over(by_turn) > 1, F.concat(F.right(F.array_join(ends, joint), F.lit(reach)), F.lit(joint))).otherwise("")
        said = said.withColumn("text", F.concat(tail, "text"))
    so_far = lambda terms: sum((F.max(F.contains("text", F.lit(t)).cast("int")).over(w) for t in terms), F.lit(0))
    e = F.greatest(F.lit(0.0), so_far(positives) - 0.5 * so_far(negatives))
    return said.select("conv_id", "turn", F.bround(e / (e + 2), 4).alias("score"))


def first_distress(turns: DataFrame, terms) -> DataFrame:
    said = turns.filter("role = 'user'")
    return said.groupBy("conv_id").agg(F.min(F.when(T.any_term(F.col("text"), terms), F.col("turn"))).alias("first_turn"))


def intents(turns: DataFrame, ordered: list[tuple[str, list[str]]]) -> DataFrame:
    """The first intent, in order, that any of its words names."""
    out = F.lit(None).cast("string")
    for name, terms in reversed(ordered):
        out = F.when(T.any_term(F.col("text"), terms), name).otherwise(out)
    return turns.filter("role = 'user'").select("conv_id", "turn", out.alias("intent"))


def speaker_changes(turns: DataFrame) -> DataFrame:
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.select("conv_id", "turn", "role", F.coalesce(F.col("role") != before, F.lit(True)).alias("changed"))


def session_state(turns: DataFrame, slots: dict[str, list[str]], questions: int, positives) -> DataFrame:
    """What each session knows after its user turns: phase, filled slots, open slots in asking
    order and the score; a session decides after ``questions`` answers, never earlier."""
    said = turns.filter("role = 'user'")
    flags = [F.max(T.any_term(F.col("text"), terms)).alias(f"s_{name}") for name, terms in slots.items()]
    hit = [F.max(F.contains("text", F.lit(t)).cast("int")).alias(f"p_{k}") for k, t in enumerate(positives)]
    one = said.groupBy("conv_id").agg(F.count(F.lit(1)).alias("answers"), *flags, *hit)
    listed = lambda want: F.array_join(F.filter(F.array(*[F.when(F.col(f"s_{n}") == want, F.lit(n)) for n in slots]), lambda x: x.isNotNull()), ",")
    e = sum((F.col(f"p_{k}") for k in range(len(positives))), F.lit(0)).cast("double")
    return one.select("conv_id", "answers", F.when(F.col("answers") > questions, "DONE").otherwise("COLLECTING").alias("phase"), listed(True).alias("filled"), listed(False).alias("open"), F.bround(e / (e + 2), 4).alias("score"))

