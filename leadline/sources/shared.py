"""The folder that all machines share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is named, a temporary one of this session on a local master alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leadline-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get()
    return named.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The name of a new folder there."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, *by: str) -> DataFrame:
    """df as a table of the shared folder: computed once, whatever reads it, and kept when an executor is lost; a folder for each value of the columns `by`."""
    path = path or scratch(df.sparkSession)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_of(spark: SparkSession, path: str):
    """(file system, path) of the JVM, for a path of any scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = path_of(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Renames a folder; fails where the new name is taken."""
    fs, p = path_of(spark, old)
    target = spark._jvm.org.apache.hadoop.fs.Path(new)
    if fs.exists(target) or not fs.rename(p, target):
        raise RuntimeError(f"{old} can't be moved to {new}")
