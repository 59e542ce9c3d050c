"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Token blocks of equal length are allotted to sources by the highest quotients votes / (2 s + 1),
each source's blocks are allotted to its shards in the same way, and each shard takes its blocks
from its documents in a seeded order, going round again where its quota exceeds its length. Blocks
are counted, never materialised.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of
its own, sorted last; null ids sort with their own seed value; rows that repeat id, source and size
are interchangeable (ties in a shard go by the seeded order, then size); texts of any length are
counted whole; an empty table gives an empty result. The result does not depend on partitions
or on the order of rows. Other columns play no part in `allot`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.common import SPACE, narrow, word_count
from sievewright.session import cut

BLOCK = 32
SHARD_TOKENS = 4_000_000
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds weight and target to (source, source_size), a table of one row per source.

    Weights repeat over the sources by code point, null last. The targets share the sum of all
    sizes by weight; none exceeds ``most`` times its source's size, and what is cut off goes to the
    others by weight. That fixed point is found in closed form: sources fill up in the order of
    cap / weight, and the first that the level does not fill sets the level.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    levels = (
        weighed.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("open"))
    )
    level = F.max(F.when(F.col("weight") * F.col("left") <= F.col("cap") * F.col("open"), F.col("level"))).over(whole)
    target = F.when(F.col("cap") > F.col("weight") * level, F.col("weight") * level).otherwise(F.col("cap").cast("double"))
    return levels.withColumn("target", F.coalesce(target, F.col("cap").cast("double"))).select("source", "source_size", "weight", "target")


def apportion(parties: DataFrame, group: list[str], votes: str, most_blocks: str, seats: str, tie: list[Column]) -> DataFrame:
    """Adds ``blocks``: ``seats`` allotted by highest quotients within each ``group``.

    With S seats, V votes and n parties, round(v / d) at d = V / (S - n / 2) gives seats that every
    Sainte-Laguë allocation gives; at d = V / (S + n / 2) it gives at least S. Only the at most 2 n
    quotients between the two are ranked. No party gets more than ``most_blocks``.
    """
    all_ = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    n, total = F.count(F.lit(1)).over(all_), F.sum(votes).over(all_)

    def rounded(shift: Column) -> Column:
        share = F.when(total > 0, F.col(votes) * shift / total).otherwise(F.lit(0.0))
        return F.least(F.floor(share + 0.5), F.col(most_blocks)).cast("long")

    sure = parties.withColumn("__low", rounded(F.greatest(F.col(seats) - n / 2, F.lit(0.0)))).withColumn("__high", rounded(F.col(seats) + n / 2 + 1))
    sure = sure.withColumn("__open", F.col(seats) - F.sum("__low").over(all_))
    offers = sure.withColumn("__seat", F.explode_outer(F.when(F.col("__high") > F.col("__low"), F.sequence("__low", F.col("__high") - 1))))
    quotient = F.col(votes) / (2 * F.col("__seat") + 1)
    ranked = offers.withColumn("__rank", F.row_number().over((all_).orderBy(quotient.desc_nulls_last(), *tie, "__seat")))
    won = F.sum(F.when((F.col("__rank") <= F.col("__open")) & F.col("__seat").isNotNull(), 1).otherwise(0))
    keys = parties.columns
    return ranked.groupBy(*keys, "__low").agg(won.alias("__won")).withColumn("blocks", (F.col("__low") + F.col("__won")).cast("long")).select(*keys, "blocks")


def allot(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_tokens: int = SHARD_TOKENS, seed: str = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken."""
    # Rows without an id go by their text, so that they spread over shards as others do.
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))).cast("binary"))
    sized = narrow(docs, doc_id=id_col, source=source_col, text=text_col).select("doc_id", "source", word_count(F.col("text")).alias("size"), order.alias("order"))
    sized = cut(sized)
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    sources = sources.withColumn("most_blocks", F.floor(most * F.col("source_size") / block)).withColumn("seats", F.floor(F.sum("source_size").over(Window.partitionBy(F.lit(1))) / block))
    name = F.asc_nulls_last("source")
    quotas = cut(apportion(sources, [], "target", "most_blocks", "seats", [name]).withColumn("shards", F.greatest(F.lit(1), F.floor(F.col("source_size") / shard_tokens)).cast("long")))
    facts = quotas.select(F.col("source").alias("q_source"), "source_size", "target", "shards", F.col("blocks").alias("quota"))
    known = sized.join(facts, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source")
    # Rows without words take none and stay out of the sorted windows, however many a source has: a
    # shard's rows are then bounded by its words.
    empty = known.filter("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    dealt = known.filter("size > 0")
    dealt = dealt.withColumn("shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % F.col("shards"))
    parts = dealt.groupBy("source", "shard", "quota").agg(F.sum("size").alias("shard_size")).withColumn("most_blocks", F.floor(most * F.col("shard_size") / block))
    parts = apportion(parts, ["source"], "shard_size", "most_blocks", "quota", [F.asc("shard")]).select(F.col("source").alias("p_source"), F.col("shard").alias("p_shard"), "shard_size", "blocks")
    placed = dealt.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("shard") == F.col("p_shard")))
    run = Window.partitionBy("source", "shard").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(run), F.lit(0)))
    words_ = F.col("blocks") * block
    rounds = F.when(F.col("shard_size") > 0, F.floor(words_ / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    rest = words_ - rounds * F.col("shard_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken")).union(empty)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the input's columns: each document as often as it is taken whole, and
    the last block's document once more cut to the words that the block still takes. A row with a
    null id goes by its text's digest; rows that share an id are each taken as the most taken is."""
    names = docs.columns
    named = docs.withColumn("__row_id", F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("null:"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))))
    shares = allot(named, "__row_id", text_col, source_col, **options).groupBy(F.col("doc_id").alias("__id")).agg(F.max("size").alias("__size"), F.max("taken").alias("__taken")).filter("__taken > 0")
    rows = named.join(shares, F.col("__row_id") == F.col("__id"))
    whole, rest = F.floor(F.col("__taken") / F.col("__size")), F.col("__taken") % F.col("__size")
    copies = F.array_repeat(F.col("__size"), whole.cast("int"))
    copies = F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)
    rows = rows.withColumn("__words", F.explode(copies))
    runs = F.split(F.col(text_col), rf"(?<=[{SPACE}])(?=[^{SPACE}])")
    lead = F.when(F.col(text_col).rlike(rf"^[{SPACE}]"), 1).otherwise(0)
    cut_text = F.when(F.col("__words") < F.col("__size"), F.array_join(F.slice(runs, 1, (F.col("__words") + lead).cast("int")), "")).otherwise(F.col(text_col))
    return rows.select(*[cut_text.alias(c) if c == text_col else F.col(c) for c in names])
