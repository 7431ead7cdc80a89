"""Event replay, live feeds, periodic steps and windowed counts as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

#: How far back a notice can speak of a message: nothing older changes a count.
HORIZON = "3 days"
#: Seconds between the runs of each step.
EVERY = {"dispatch": 60, "classify": 1800, "bounces": 1800, "replies": 1800, "retries": 21600}


def replay(events: DataFrame, after: int, seq: str = "event_id") -> DataFrame:
    """Events after a cursor; batch or stream."""
    return events.where(F.col(seq) > after)


def feed(events: DataFrame, after: int, seq: str = "event_id", at: str = "ts", key: str | None = None, value=None) -> DataFrame:
    """A stream of events after a cursor, first those that are there, then new ones, each once; of one job or tenant if `key` is given.

    The source is one and the same for both parts, so that none falls between them; its checkpoint is the cursor from then on.
    """
    some = replay(events, after, seq)
    if key is not None:
        some = some.where(F.col(key) == value)
    return some.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", HORIZON).dropDuplicatesWithinWatermark([seq]).drop("_at")


def live(events: DataFrame, since, at: str = "ts") -> DataFrame:
    """A tenant's stream without what was before: events from a time on."""
    return events.where(F.col(at) >= since)


def periodic(rows: DataFrame, step: Callable[[DataFrame, int], None], name: str, checkpoint: str, once: bool = False, mode: str = "append", seconds: float | None = None) -> StreamingQuery:
    """Runs step(batch, number) every so often, as `EVERY` says unless seconds are named, or over all that is there and no more."""
    writer = rows.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{EVERY.get(name, 60) if seconds is None else seconds} seconds")).start()


def into_log(path: str) -> Callable[[DataFrame, int], None]:
    """A step that writes a batch to its own folder of a log, over what an attempt before may have left: a batch that comes again
    adds nothing, and no batch reads what others wrote."""
    return lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")


def log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What `into_log` wrote, as one table of this schema."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = HORIZON, key: str = "event_id") -> DataFrame:
    """Counts and sums by window and kind, each event once: events behind the watermark are dropped, row by row, and told of in
    the stream's progress (`landing.dropped`); a window comes out once the watermark has passed its end."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key])
    return timed.groupBy(F.window("_at", window), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
