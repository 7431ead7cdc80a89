"""Tables by name, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_tabs(tabs: dict[str, DataFrame]) -> DataFrame:
    """One frame of several: `_tab` first, headers united, missing cells null."""
    out = None
    for name, df in tabs.items():
        df = df.select(F.lit(name).alias("_tab"), *[F.col(c).cast("string") for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns by name, as JSON: a null differs from '', and no value can reach into its neighbour."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
