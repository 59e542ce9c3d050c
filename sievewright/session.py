"""Session helpers: table access and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a dataset folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Where none is set, a local session (tests) gets one of
    its own; on a cluster that is an error, since executors don't share local folders."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def passing(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder for what the session's results read: what lies there goes
    when the session's driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)  # only what exists can be marked
    files.deleteOnExit(folder)
    return path


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back; its true size then
    guides the planner's choice of joins."""
    spark = df.sparkSession
    path = passing(spark, "table") + "/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job in the shared checkpoint folder, which go when the job no longer needs them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = passing(spark, "job")
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = made, path
        return made

    def drop(self, df: DataFrame | None) -> None:
        """Remove a kept table; frames that read it can't be used any more."""
        if df is not None and id(df) in self.paths:
            _, path = self.paths.pop(id(df))
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def drop_all_but(self, *kept: DataFrame) -> None:
        names = {id(df) for df in kept}
        for df, _ in list(self.paths.values()):
            if id(df) not in names:
                self.drop(df)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the session's Python workers, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_sievewright_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "sievewright_source.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._sievewright_shipped = True
