"""Evaluation: retrieval, classification, agreement, error rate and latency metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.edits import edits

RANGES = 1024  #: ranges of values in which exact places are looked for


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def hit_rate_at_k(df: DataFrame, k: int = 5) -> DataFrame:
    """Share of queries of which any relevant document is among the first k (retrieved, relevant)."""
    return df.agg(F.round(F.coalesce(F.avg(F.arrays_overlap(F.slice("retrieved", 1, k), "relevant").cast("double")), F.lit(0.0)), 6).alias("hit_rate"))


def mrr_at_k(df: DataFrame, k: int = 10) -> DataFrame:
    place = F.array_min(F.filter(F.transform("relevant", lambda r: F.array_position(F.slice("retrieved", 1, k), r)), lambda p: p > 0))
    return df.agg(F.round(F.coalesce(F.avg(F.coalesce(1 / place, F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"))


def hit_rate(first: DataFrame, k: int = 5) -> DataFrame:
    """As `hit_rate_at_k`, from the rank ``r`` of each query's first hit (null: none)."""
    return first.agg(F.round(F.coalesce(F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("double")), F.lit(0.0)), 6).alias("hit_rate"))


def mean_reciprocal(first: DataFrame, k: int = 10) -> DataFrame:
    return first.agg(F.round(F.coalesce(F.avg(F.when(F.col("r") <= k, 1 / F.col("r")).otherwise(0.0)), F.lit(0.0)), 6).alias("mrr"))


def latency_p95(df: DataFrame, ms: str, by: list[str]) -> DataFrame:
    """The value at place round-half-even(0.95 n), at least 1, of the sorted values."""
    place = lambda n: F.greatest(F.lit(1), F.least(n, F.bround(0.95 * n).cast("long")))
    return value_at(df, ms, by, {"p95": place}).select(*by, "p95")


def value_at(df: DataFrame, value: str, by: list[str], places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """The values at stated places (from 1, as functions of the group's size) of each group's sorted
    values, exactly, and the size as ``n``.

    Equal values are counted before anything is sorted. The counts are cut into RANGES ranges by
    value, whose sums show in which range a place lies; only that range's values are then ordered.
    A group's share of a task is therefore its counts in one range, not the group."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ends = counts.groupBy(*by).agg(F.sum("__c").alias("n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    width = F.col("__high").cast("double") - F.col("__low").cast("double")
    part = F.least(F.lit(RANGES - 1), F.floor(F.coalesce(F.try_divide(F.col("__v").cast("double") - F.col("__low").cast("double"), width), F.lit(0.0)) * RANGES)).cast("int")
    cut = counts.join(ends, by).withColumn("__part", part)
    sums = cut.groupBy(*by, "n", "__part").agg(F.sum("__c").alias("__s"))
    upto = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    named = F.array(*[F.struct(F.lit(k).alias("k"), p(F.col("n")).cast("long").alias("at")) for k, p in places.items()])
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(upto), F.lit(0))).withColumn("__p", F.explode(named))
    wanted = before.filter((F.col("__p.at") > F.col("__before")) & (F.col("__p.at") <= F.col("__before") + F.col("__s")))
    inside = cut.join(wanted.select(*by, "__part", "__before", "__p"), [*by, "__part"])
    so_far = Window.partitionBy(*by, "__p.k").orderBy("__v")
    hit = inside.withColumn("__end", F.col("__before") + F.sum("__c").over(so_far)).filter(F.col("__end") >= F.col("__p.at"))
    found = hit.groupBy(*by, "__p.k").agg(F.min("__v").alias("__v"))
    picked = found.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, F.col("__v"))).alias(k) for k in places])
    return ends.select(*by, "n").join(picked, by)


def median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, median), exactly: the mean of the two middle values."""
    halves = value_at(df, value, by, {"__a": lambda n: F.floor((n + 1) / 2), "__b": lambda n: F.floor(n / 2) + 1})
    return halves.select(*by, "n", ((F.col("__a").cast("double") + F.col("__b").cast("double")) / 2).alias("median"))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def per_label(df: DataFrame, truth: str, pred: str, digits: int | None = 6) -> DataFrame:
    """Precision, recall, F1 and support over all labels that occur as truth or prediction."""
    cells = confusion(df, truth, pred)
    sides = cells.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    p, r = share(F.col("hit"), F.col("predicted")), share(F.col("hit"), F.col("support"))
    shown = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return sums.select("label", "support", shown(p).alias("precision"), shown(r).alias("recall"), shown(share(2 * p * r, p + r)).alias("f1"))


def macro_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Mean F1 over labels with support, and accuracy."""
    f1 = per_label(df, truth, pred, None).agg(F.round(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)), 5).alias("macro_f1"))
    acc = df.agg(F.round(F.coalesce(F.avg((F.col(truth) == F.col(pred)).cast("double")), F.lit(0.0)), 6).alias("accuracy"))
    return f1.crossJoin(acc)


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chance-corrected agreement; no rows give 0, certain agreement by chance gives 1."""
    cells = confusion(df, a, b)
    n = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))), F.lit(0)).alias("same"))
    left, right = cells.groupBy(F.col("y_true").alias("y")).agg(F.sum("n").alias("l")), cells.groupBy(F.col("y_pred").alias("y")).agg(F.sum("n").alias("r"))
    chance = left.join(right, "y").agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("c"))
    expected, observed = F.col("c") / (F.col("n") * F.col("n")), F.col("same") / F.col("n")
    kappa = F.when(F.col("n") == 0, 0.0).when(F.col("c") == F.col("n") * F.col("n"), 1.0).otherwise(F.try_divide(observed - expected, 1 - expected))
    return n.crossJoin(chance).select("n", F.round(kappa, 6).alias("kappa"))


def corpus_cer(df: DataFrame, reference: str, heard: str, distance=edits) -> DataFrame:
    """All edits over all reference characters."""
    return df.agg(F.round(share(F.sum(distance(F.col(reference), F.col(heard))), F.sum(F.char_length(reference))), 6).alias("corpus_cer"))


def relative_gain(base: Column, new: Column) -> Column:
    return F.when(base > 0, (new - base) / base).otherwise(F.lit(0.0))


def score_table(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(metric, value) against (metric, threshold, direction); unknown metrics have 0.0, ge."""
    joined = values.join(F.broadcast(thresholds), "metric", "left")  # one row per metric
    limit, way = F.coalesce("threshold", F.lit(0.0)), F.coalesce("direction", F.lit("ge"))
    return joined.select("metric", "value", limit.alias("threshold"), way.alias("direction"), F.when(way == "ge", F.col("value") >= limit).otherwise(F.col("value") <= limit).alias("passed"))
