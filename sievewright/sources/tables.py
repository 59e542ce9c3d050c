"""Corpus, index and masked-text tables."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

CASE_SCHEMA = "case_id string, text string, label string, date string, county string, county_id string, source string"


def corpus_path(default: str, fallback: str | None = None, variable: str = "CORPUS_PARQUET", exists=os.path.exists) -> str:
    """The variable's path, else the default, else the fallback; an error that says what to do."""
    for path in (os.environ.get(variable), default, fallback):
        if path and exists(path):
            return path
    raise FileNotFoundError(f"no corpus: set {variable} or write {default}")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE_SCHEMA).parquet(path)


def write_corpus(df: DataFrame, path: str) -> dict:
    """Zstandard parquet of the first row, as read, of each case id; returns the provenance counts, taken while
    writing, and leaves them as JSON beside the table, in ``<path>.meta``."""
    read, seen = Observation("read"), Observation("corpus")
    first = df.observe(read, F.count(F.lit(1)).alias("read"))
    if "case_id" in df.columns:
        # Rows come in the order in which they are read; those without an id are each their own.
        first = first.withColumn("__row", F.monotonically_increasing_id())
        own = F.coalesce(F.concat(F.lit("="), F.col("case_id").cast("string")), F.col("__row").cast("string"))
        place = F.row_number().over(Window.partitionBy(own).orderBy("__row"))
        first = first.withColumn("__place", place).filter("__place = 1").drop("__place", "__row")
    first.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("text") == "").alias("empty"), F.max(F.char_length("text")).alias("longest")).write.mode("overwrite").option("compression", "zstd").parquet(path)
    facts = {**seen.get, "duplicates_dropped": read.get["read"] - seen.get["rows"], "columns": df.columns}
    df.sparkSession.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}.meta")
    return facts


def write_index(df: DataFrame, path: str) -> None:
    """Vectors by model, so that a reader prunes to the model it can use."""
    df.write.mode("overwrite").partitionBy("model").parquet(path)


def read_index(spark: SparkSession, path: str, model: str, dim: int) -> DataFrame:
    """Rows of a compatible model and width; empty means that the index must be rebuilt."""
    return spark.read.parquet(path).filter((F.col("model") == model) & (F.size("embedding") == dim))


def store_uploads(df: DataFrame, content: str, suffix: str, order: str | None = None) -> DataFrame:
    """Content-addressed names; of equal bytes the first in ``order`` (the path's order where none is
    given) stays. Unreadable rows, whose content is null, all stay and have no name."""
    key = F.sha2(content, 256)
    named = df.withColumn("content_key", key).withColumn("path", F.concat(F.substring(key, 1, 32), F.lit(suffix)))
    place = F.row_number().over(Window.partitionBy("content_key").orderBy(order or "path"))
    first = named.filter("content_key is not null").withColumn("__place", place).filter("__place = 1").drop("__place")
    return first.unionByName(named.filter("content_key is null"))


def write_masked(df: DataFrame, column: str, path: str) -> None:
    """A sink for masked text: takes only a struct that carries its masking version."""
    kind = df.schema[column].dataType
    if "deid_version" not in getattr(kind, "fieldNames", lambda: [])():
        raise TypeError(f"{column} is raw text; mask it first")
    df.write.mode("overwrite").parquet(path)
