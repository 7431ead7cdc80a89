"""Tables that land part by part, and streams that are run after each part as a service would be that stops and goes on."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from leadline.sources.shared import exists, move

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings (dots as __) for a while, the former ones after it."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    former = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in former.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def moved(spark: SparkSession, staged: str) -> Callable[[str], None]:
    """Lands a folder that is written already as one within another, by its name alone; one that isn't there lands nothing."""
    return lambda path: move(spark, staged, f"{path}/{uuid.uuid4().hex}") if exists(spark, staged) else None


def in_parts(parts: Iterable[dict[str, DataFrame | Callable[[str], None]]], start: Callable[[], StreamingQuery]) -> list[dict]:
    """Lands each part (folder: rows, or what lands them there) and runs the query to the end of what is there, from its checkpoint on; what all runs told of their batches.

    Folders should hold a file before the first start; a part may leave a folder out.
    """
    told: list[dict] = []
    for part in parts:
        for path, rows in part.items():
            rows.write.mode("append").parquet(path) if isinstance(rows, DataFrame) else rows(path)
        query = start()
        query.awaitTermination()
        told += [p if isinstance(p, dict) else p.__dict__ for p in query.recentProgress]
    return told


def dropped(told: list[dict], operator: str | None = None) -> int:
    """Rows that a stateful operator (all of them, if none is named) dropped as behind the watermark."""
    return sum(o["numRowsDroppedByWatermark"] for p in told for o in p["stateOperators"] if operator in (None, o["operatorName"]))


def kept_rows(told: list[dict]) -> int:
    """Rows of state after the last batch."""
    return sum(o["numRowsTotal"] for o in told[-1]["stateOperators"]) if told else 0
