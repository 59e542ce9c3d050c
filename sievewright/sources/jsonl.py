"""JSON-lines source and sink: one record a line, LF only, non-ASCII as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, _parse_datatype_string


def read(spark: SparkSession, path: str, schema: str, missing: str = "") -> DataFrame:
    """Records of a stated schema. U+2028 and the like stay inside a record, blank lines are
    skipped, absent string fields get the default, malformed lines fail the read."""
    kinds = _parse_datatype_string(schema)
    raw = spark.read.schema(kinds).option("mode", "FAILFAST").option("lineSep", "\n").json(path)
    return raw.select(*[F.coalesce(c, F.lit(missing)).alias(c) if isinstance(f.dataType, StringType) else F.col(c) for f in kinds for c in [f.name]])


def write(df: DataFrame, path: str) -> str:
    df.write.option("lineSep", "\n").json(path)
    return path
