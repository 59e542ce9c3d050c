"""Corpus analytics: coverage, cross-tabs, positions, discrimination, sweeps and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text as T
from sievewright.operators import metrics


def label_coverage(df: DataFrame, label: str) -> DataFrame:
    """Label counts, largest first, with the share of all rows that the labels so far cover."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("n"), "label")
    whole = Window.partitionBy(F.lit(1))
    return counts.withColumn("cumulative", F.round(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(whole), 6)).withColumn("place", F.row_number().over(order))


def crosstab(df: DataFrame, rows: str, cols: Column, values: list[str]) -> DataFrame:
    counted = df.withColumn("__c", cols).groupBy(rows).agg(*[F.count_if(F.col("__c") == v).alias(v) for v in values])
    return counted


def positions(df: DataFrame, text: str, first: str, second: str) -> DataFrame:
    """Where a term stands, relative to the text's length, and how often it goes before another."""
    at, other = F.instr(F.col(text), first), F.instr(F.col(text), second)
    rel = at / F.char_length(text)
    held = df.filter(at > 0)
    middle = metrics.median(held.select(F.lit(1).alias("one"), rel.alias("rel")), "rel", ["one"]).select(F.round("median", 6).alias("median_position"))
    sums = held.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((rel <= 0.2).cast("double")), 6).alias("in_first_fifth"), F.round(F.avg(F.when(other > 0, (at < other).cast("double"))), 6).alias("before_other"))
    return sums.join(middle, F.lit(True), "left").select("n", "median_position", "in_first_fifth", "before_other")  # one row each


def term_rates(df: DataFrame, text: str, positive: Column, terms: list[str]) -> DataFrame:
    """Per term: rate among positives and negatives, their difference and ratio. One scan."""
    long = df.select(positive.alias("p"), F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.contains(F.col(text), F.lit(t)).cast("double").alias("hit")) for t in terms])).alias("s"))
    rates = long.groupBy("s.term").agg(F.avg(F.when(F.col("p"), F.col("s.hit"))).alias("a"), F.avg(F.when(~F.col("p"), F.col("s.hit"))).alias("b"))
    return rates.select("term", F.round("a", 6).alias("pos_rate"), F.round("b", 6).alias("neg_rate"), F.round(F.col("a") - F.col("b"), 6).alias("discrimination"), F.round(F.try_divide("a", "b"), 6).alias("lift"))


def threshold_sweep(df: DataFrame, score: Column, positive: Column, cuts: list[float]) -> DataFrame:
    long = df.select(score.alias("s"), positive.alias("p")).select("s", "p", F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut"))
    return long.groupBy("cut").agg(F.round(F.avg(F.when(F.col("p"), (F.col("s") >= F.col("cut")).cast("double"))), 6).alias("accepted"), F.round(F.avg(F.when(~F.col("p"), (F.col("s") >= F.col("cut")).cast("double"))), 6).alias("false_accepted"))


def score_distribution(scores: DataFrame, threshold: float) -> DataFrame:
    """Per query: best, 10th and 100th score, median, and how many reach the threshold."""
    place = lambda k: lambda n: n - k + 1  # noqa: E731  (places count from the least)
    places = {"best": place(1), "tenth": place(10), "hundredth": place(100), "__a": lambda n: F.floor((n + 1) / 2), "__b": lambda n: F.floor(n / 2) + 1}
    at = metrics.value_at(scores, "score", ["query_id"], places)
    above = scores.groupBy("query_id").agg(F.count_if(F.col("score") >= threshold).alias("n_above"))
    return at.join(above, "query_id").select("query_id", "best", "tenth", "hundredth", F.round((F.col("__a") + F.col("__b")) / 2, 6).alias("median"), "n_above")


def quarterly_share(df: DataFrame, ts: str, wanted: Column) -> DataFrame:
    by = df.groupBy(F.date_trunc("quarter", ts).cast("date").alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.avg(wanted.cast("double")).alias("raw"))
    before = F.lag("raw").over(Window.orderBy("quarter"))
    return by.select("quarter", "n", F.round("raw", 6).alias("share"), F.round(F.col("raw") - before, 6).alias("change"))


def segment_overlap(df: DataFrame, a: Column, b: Column) -> DataFrame:
    both = F.count_if(a & b)
    return df.agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), both.alias("n_both"), F.round(F.try_divide(both, F.count_if(a)), 6).alias("share_of_a"), F.round(F.try_divide(both, F.count_if(b)), 6).alias("share_of_b"))


def cooccurrence(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """For every ordered pair of flags: how often the second holds where the first does."""
    marked = df.select(*[c.alias(n) for n, c in flags.items()])
    pairs = [F.struct(F.lit(a).alias("given"), F.lit(b).alias("then"), F.col(a).alias("x"), (F.col(a) & F.col(b)).alias("y")) for a in flags for b in flags if a != b]
    long = marked.select(F.explode(F.array(*pairs)).alias("s"))
    return long.groupBy("s.given", "s.then").agg(F.count_if("s.x").alias("n"), F.round(F.try_divide(F.count_if("s.y"), F.count_if("s.x")), 6).alias("rate"))


def keyword_hits(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    return df.withColumn("hits", T.hits(F.col(text), terms))
