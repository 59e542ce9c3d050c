"""Uploaded files as binary rows: each content once, under a name made of it, however often it comes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder; Spark leaves files without
    bytes out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def named(files: DataFrame, suffix: str) -> DataFrame:
    """(path, name, content) of (path, content): of equal contents one, with the first path, under the first
    32 digits of its digest. Files that could not be read, whose content is null, all stay, without a name.

    Copies meet as partial minima, a row a content and task, however many there are."""
    key = F.sha2("content", 256)
    once = files.filter("content is not null").groupBy(key.alias("key")).agg(F.min("path").alias("path"), F.first("content").alias("content"))
    kept = once.select("path", F.concat(F.substring("key", 1, 32), F.lit(suffix)).alias("name"), "content")
    return kept.unionByName(files.filter("content is null").select("path", F.lit(None).cast("string").alias("name"), "content").distinct())


def _new(rows: DataFrame, key: str, path: str, batch: int) -> DataFrame:
    """Rows whose key no other batch has written."""
    try:
        there = rows.sparkSession.read.parquet(path).filter(F.col("batch") != batch).select(key)
    except AnalysisException:
        return rows
    return rows.join(there, key, "left_anti").select(*rows.columns)


def put_once(files: DataFrame, batch: int, path: str) -> None:
    """Writes the named files of a batch that no other batch has written, in a folder of the batch's own: a
    batch that is run again writes the same folder again, and nothing twice."""
    for rows, key, where in ((files.filter("name is not null"), "name", "files"), (files.filter("name is null").select("path"), "path", "unreadable")):
        fresh = _new(rows, key, f"{path}/{where}", batch)
        if where == "files" or not fresh.isEmpty():
            fresh.write.mode("overwrite").parquet(f"{path}/{where}/batch={batch}")


def keep(stream: DataFrame, path: str, suffix: str, checkpoint: str) -> StreamingQuery:
    """Keeps what a stream of files brings: (path, name, content) once each in ``files``, and the paths of
    unreadable ones in ``unreadable``."""
    put = lambda rows, batch: put_once(named(rows, suffix), batch, path)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
