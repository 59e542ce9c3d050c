"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression, whatever the optimiser merges around it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of ``text``; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


#: Keys that more rows than this ask for are looked up in so many slices.
WIDE, SLICES = 1000, 64


def attach(rows: DataFrame, key: str, known: DataFrame, width: str, spread: Column) -> DataFrame:
    """Adds to ``rows`` what ``known``, one row per ``key``, has for them, or nulls. Its column ``width`` says
    how many rows ask for a key; the widely asked for are met in slices of ``spread``, which has the key's
    type and tells rows apart."""
    values = [c for c in known.columns if c not in (key, width)]
    wide = known.filter(F.col(width) > WIDE).select(key, *[F.col(c).alias(f"__{c}") for c in values], F.lit(True).alias("__wide"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("__slice"))
    few = known.filter(F.col(width) <= WIDE).select(F.col(key).alias("__asked"), *values)
    dealt = rows.withColumn("__slice", F.pmod(F.xxhash64(spread), F.lit(SLICES)).cast("int")).join(wide, [key, "__slice"], "left")
    asked = dealt.withColumn("__asked", F.when(F.col("__wide").isNull(), F.col(key)).otherwise(spread))
    found = asked.join(few, "__asked", "left")
    return found.select(*[found[c] for c in rows.columns], *[F.when(F.col("__wide"), F.col(f"__{c}")).otherwise(found[c]).alias(c) for c in values])


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under internal names: other columns can't clash with results."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])
