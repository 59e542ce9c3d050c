"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document; the ledger keeps the measurements and one bit for
each failed rule. Policies (sets of rules, by version) and ablations are bit operations on it.

Defined results: a null or empty text has no words and fails the base rule; ratios with a zero
denominator are 0; repeated rows are judged alike, each on its own; texts are measured whole, at
any length. Other columns play no part in `ledger`, and `accepted` returns them untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import SPACE, WORD, let, narrow, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rules by bit, as (name, failure condition over the measurements).
RULES: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("few_words", lambda m: m["n_words"] < 20),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > m["word_chars"]),
    ("repeated_lines", lambda m: (m["n_dup_lines"] > 3) & (2 * m["n_dup_lines"] > m["n_lines"])),
    ("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    ("shouting", lambda m: (m["n_marks"] > 20) & (4 * m["n_marks"] > m["n_words"])),
)
BASE = 0b11
#: Policies by version: the rules that reject.
POLICIES = {"v1": 0b11, "v2": 0b111111}


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the same text, first finds included."""
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda marks: _repeats(marks, window))


def _repeats(marks: Column, window: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(marks) - (window - 1))
    prints = F.transform(starts, lambda i: F.xxhash64(F.slice(marks, i, window)))
    found = let(prints, lambda p: F.when(F.size(F.array_distinct(p)) < F.size(p), _covered(p, window)).otherwise(F.lit(0)))
    return F.when(F.size(marks) > window, found).otherwise(F.lit(0))


def _covered(prints: Column, window: int) -> Column:
    """Sorted by print, repeats are neighbours; their positions in order give the covered words."""
    tagged = F.sort_array(F.transform(prints, lambda p, i: F.struct(p.alias("p"), i.alias("i"))))
    pairs = let(tagged, lambda t: F.zip_with(t, F.slice(t, 2, F.size(t)), lambda a, b: F.when(a["p"] == b["p"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    places = F.sort_array(F.array_distinct(F.flatten(pairs)))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(window), x - acc["last"])).alias("n")), lambda acc: acc["n"])


def measure(text: Column) -> Column:
    """Struct of what the rules are about, from one text."""

    def parts(t: Column) -> Column:
        without = lambda drop: (F.char_length(t) - F.char_length(F.translate(t, drop, ""))).cast("long")
        lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(WORD))
        return let(
            F.struct(words(t).alias("words"), lines.alias("lines")),
            lambda x: F.struct(
                F.size(x["words"]).cast("long").alias("n_words"),
                F.char_length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
                without(SYMBOLS).alias("n_symbols"),
                without("!").alias("n_marks"),
                F.size(x["lines"]).cast("long").alias("n_lines"),
                (F.size(x["lines"]) - F.size(F.array_distinct(x["lines"]))).cast("long").alias("n_dup_lines"),
                repeat_words(x["words"]).cast("long").alias("n_repeat_words"),
            ),
        )

    return let(F.coalesce(text, F.lit("")), parts)


def failure_bits(measured: Column, rules=RULES) -> Column:
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(fails(measured), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """doc_id, the measurements, and ``failed``: a bit for each rule that the document fails."""
    both = let(measure(F.col("text")), lambda m: F.struct(m.alias("m"), failure_bits(m, rules).alias("failed")))
    return narrow(docs, doc_id=id_col, text=text_col).select("doc_id", both.alias("x")).select("doc_id", "x.m.*", "x.failed")


def _hits(failed: Column, mask: int) -> Column:
    return failed.bitwiseAND(F.lit(mask).cast("long")) != 0


def apply_policy(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds base_failed and kept under one policy version; no rule is evaluated again."""
    return entries.withColumn("base_failed", _hits(F.col("failed"), BASE)).withColumn("kept", ~_hits(F.col("failed"), BASE | POLICIES[policy]))


def ablations(entries: DataFrame, policy: str = "v2", rules=RULES) -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many only it rejects."""
    mask = POLICIES[policy]
    failed = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    counts = entries.groupBy(failed.alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.struct(F.lit(k).alias("bit"), F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("mask")) for k, (name, _) in enumerate(rules) if mask >> k & 1])
    each = counts.select("failed", "n", F.explode(names).alias("r"))
    hit, alone = F.col("failed").bitwiseAND(F.col("r.mask")) != 0, F.col("failed") == F.col("r.mask")
    return each.groupBy("r.bit", "r.rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"))


def accepted(docs: DataFrame, text_col: str = "text", policy: str = "v2") -> DataFrame:
    """The input's rows that the policy keeps, columns untouched; a map-side filter."""
    keeps = let(measure(docs[text_col]), lambda m: ~_hits(failure_bits(m), BASE | POLICIES[policy]))
    return docs.filter(keeps)
