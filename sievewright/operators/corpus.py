"""Corpus preparation: normalising, filtering, first-wins de-duplication, funnels and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text as T

CASE = ("case_id", "text", "label", "date", "county", "county_id", "source")


def normalise(df: DataFrame, fields: dict[str, str], source: str) -> DataFrame:
    """Rename and cast raw fields to the case schema; absent fields become empty strings."""
    cols = [T.blank(F.col(fields[c]).cast("string")).alias(c) if c in fields else F.lit("").alias(c) for c in CASE[:-1]]
    return df.select(*cols, F.lit(source).alias("source"))


def first_wins(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of every key in a stated order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def label_in(df: DataFrame, label: str, wanted: list[str]) -> DataFrame:
    return df.filter(T.norm_label(F.col(label)).isin([w for w in wanted]))


def label_contains(df: DataFrame, label: str, labels: list[str], excludes: list[str]) -> DataFrame:
    """Case-insensitive substring match; an excluded term always rejects."""
    return df.filter(~T.any_term(F.col(label), excludes, False) & T.any_term(F.col(label), labels, False))


def facets(text: Column, table: dict[str, list[str]]) -> Column:
    """Values whose words occur in the lower-cased text, in vocabulary order."""
    low = F.lower(text)
    tags = [F.when(T.any_term(low, [w.lower() for w in words]), F.lit(value)) for value, words in table.items()]
    return F.filter(F.array(*tags), lambda x: x.isNotNull())


def derive_facets(df: DataFrame, text: str, tables: dict[str, dict[str, list[str]]], label: str | None = None, label_facet: str = "category") -> DataFrame:
    """Adds ``facets``, a map of arrays; label tags come first in their facet."""
    entries = []
    for name, table in tables.items():
        value = facets(F.col(text), table)
        if label and name == label_facet:
            value = F.concat(facets(F.col(label), table), value)
        entries += [F.lit(name), F.array_distinct(value)]
    return df.withColumn("facets", F.create_map(*entries))


def parse_query(query: Column, tables: dict[str, dict[str, list[str]]], groups: dict[str, list[str]], group_facet: str = "channel") -> Column:
    """Facet filters of a question; group names (matched as written) expand; facets without a hit are left out."""
    entries = []
    for name, table in tables.items():
        value = facets(query, table)
        if name == group_facet:
            wide = F.flatten(F.filter(F.array(*[F.when(F.contains(query, F.lit(g)), F.array(*[F.lit(v) for v in vs])) for g, vs in groups.items()]), lambda x: x.isNotNull()))
            value = F.concat(value, wide)
        entries += [F.lit(name), F.array_distinct(value)]
    return F.map_filter(F.create_map(*entries), lambda _, v: F.size(v) > 0)


def facet_match(facets_: Column, filters: Column) -> Column:
    """Every filtered facet shares a value with the row's; an absent facet never does."""
    return F.forall(F.map_entries(filters), lambda e: F.arrays_overlap(F.coalesce(F.try_element_at(facets_, e["key"]), F.array().cast("array<string>")), e["value"]))


def facet_coverage(df: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Per facet: sorted used values, and vocabulary values that no row has, in vocabulary order."""
    used = df.select(F.explode("facets").alias("facet", "values")).groupBy("facet").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("values")))).alias("used"))
    vocab = F.create_map(*[x for k, vs in vocabulary.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in vs]))])
    return used.withColumn("unused", F.array_except(F.try_element_at(vocab, "facet"), "used"))


def known_values(df: DataFrame, facet: str) -> DataFrame:
    return df.select(F.explode(F.try_element_at("facets", F.lit(facet))).alias("value")).distinct()


def unknown_values(df: DataFrame, facet: str, vocabulary: list[str]) -> DataFrame:
    """Violations: facet values outside the vocabulary."""
    return known_values(df, facet).filter(~F.col("value").isin(vocabulary))


def funnel(df: DataFrame, steps: list[tuple[str, Column]], keys: list[Column], order: list[Column]) -> DataFrame:
    """How many rows pass the first k conditions, for every k, and how many keys remain in the end.

    The last count is of keys among the rows that pass all conditions; both come from one scan.
    """
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("scanned")]
    for name, condition in steps:
        passed = passed & condition
        counts.append(F.count_if(passed).alias(name))
    key = F.when(passed, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]))
    return df.agg(*counts, F.count_distinct(key).alias("written"))


def stats(df: DataFrame, label: str, county: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("cases"), F.count_distinct(F.nullif(F.col(label), F.lit(""))).alias("labels"), F.count_distinct(F.nullif(F.col(county), F.lit(""))).alias("counties"))


def remove_source(df: DataFrame, source: str) -> DataFrame:
    if not source:
        raise ValueError("a source is needed")
    return df.filter(F.col("source") != source)


def compatible_index(df: DataFrame, model: str, dim: int) -> DataFrame:
    """Index rows of the stated model and width; none means that the index must be rebuilt."""
    return df.filter((F.col("model") == model) & (F.size("embedding") == dim))


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Rows in an order that depends on ids and seed only, with the key that they go by."""
    return df.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))).orderBy("shuffle_key", id_col)
