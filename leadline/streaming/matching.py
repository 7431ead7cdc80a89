"""Notices matched to messages as both stream in.

A notice speaks of a message by our reference, by the mail system's id, or by its address alone; a message is looked for under
all three at once, one equi-join of keys within an interval of time. Both sides have a watermark, so the join forgets messages
that no notice can reach any more, and gives out a key that found nothing when no message can come for it. The best key
of a notice decides, of messages found by address the newest: the match comes out when the notice's time is behind the watermark.

`matched` has the messages of a batch and of the days before as Spark's state, row by row and, in the default state store, in memory. `settle` finds the
same as a step by batch: what a batch brought and what is left of the batches before lie in tables. An address of very many messages and notices makes
no pairs of them: keys are split into stretches of time, in which one sorted pass tells each notice the newest message before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadline.sources.shared import remove

#: Which way a notice found its message, by the first letter of the key; 9 found nothing.
TIERS = {"m": 1, "g": 2, "t": 3}
NOTHING = 9
#: Microseconds.
DAY = 86_400_000_000
#: How many times the days that a notice looks back make a stretch of time.
STRETCH = 4


def _keys(rows: DataFrame, kept: list[str], name: str, ref: str, mail: str, address: str, *more: Column) -> DataFrame:
    """The columns `kept` by each key that isn't null, with its letter."""
    named = F.array(F.concat(F.lit("m:"), F.col(ref).cast("string")), F.concat(F.lit("g:"), F.col(mail)), F.concat(F.lit("t:"), F.lower(address)), *more)
    return rows.select(*kept, F.explode(named).alias(name)).where(F.col(name).isNotNull())


def _asked(n: DataFrame, name: str, *more: Column) -> DataFrame:
    return _keys(n, ["notice_id", "seen"], name, "ref", "gmail", "email", *more)


def _sent(m: DataFrame, name: str) -> DataFrame:
    return _keys(m, ["message_id", "sent"], name, "message_id", "gmail_id", "to_email")


def matched(notices: DataFrame, messages: DataFrame, days: int = 3, late: str = "1 hour") -> DataFrame:
    """(notice_id, message_id, tier) of streams of notices (notice_id, ref, gmail, email, seen_at) and messages (message_id, gmail_id, to_email, sent_at).

    A message counts that was sent in the `days` before the notice. A notice that finds none has nulls.
    """
    n = notices.withColumn("seen", F.col("seen_at").cast("timestamp")).withWatermark("seen", late)
    m = messages.withColumn("sent", F.col("sent_at").cast("timestamp")).withWatermark("sent", late)
    return _met(n, m, days)


def _met(n: DataFrame, m: DataFrame, days: int) -> DataFrame:
    """Notices with the time `seen` and the best of the messages, with the time `sent`, that they reach, as a join of two streams."""
    alone = F.concat(F.lit("n:"), F.col("notice_id").cast("string"))  # meets nothing, so that every notice has a row
    return _best(_asked(n, "n_key", alone).join(_sent(m, "m_key"), F.expr(f"n_key = m_key AND sent <= seen AND sent > seen - INTERVAL {days} DAYS"), "leftOuter"))


def _best(met: DataFrame) -> DataFrame:
    """The best of the messages that were found for a notice, nulls where there is none."""
    letter = F.substring("n_key", 1, 1)
    tier = F.when(F.col("message_id").isNull(), NOTHING)
    for name, level in TIERS.items():
        tier = tier.when(letter == name, level)
    best = F.min(F.struct(tier.alias("tier"), (-F.unix_micros("sent")).alias("age"), (-F.col("message_id")).alias("message")))
    out = met.groupBy("notice_id", "seen").agg(best.alias("x"))
    return out.select("notice_id", (-F.col("x.message")).alias("message_id"), F.when(F.col("x.tier") < NOTHING, F.col("x.tier")).alias("tier"))


def _met_in_time(n: DataFrame, m: DataFrame, days: int) -> DataFrame:
    """The rows of `_met` of two tables, in work that grows with their rows alone, however many have one key.

    Keys are split into stretches of time: a message stands in the one in which it was sent, a notice in those that the `days` before it touch. Messages of a
    key and stretch that no notice has are left out by a hash of both, which may let others pass. Of the rest, in order of time, the last one before a
    notice is its newest.
    """
    width = days * DAY
    stretch = lambda micros: F.floor(micros / (STRETCH * width))
    place, at = F.xxhash64("key", "stretch").alias("place"), F.unix_micros
    asks = _asked(n, "key").withColumn("stretch", F.explode(F.sequence(stretch(at("seen") - width), stretch(at("seen"))))).select("*", place)
    sent = _sent(m, "key").withColumn("stretch", stretch(at("sent"))).select("*", place)
    sent = sent.join(asks.select("place").distinct().hint("shuffle_hash"), "place", "left_semi")
    by, no_id = ["place", "key", "stretch"], F.lit(None).cast("long")
    rows = asks.select(*by, F.col("seen").alias("at"), F.lit(True).alias("asks"), "notice_id", no_id.alias("message_id"))
    rows = rows.unionByName(sent.select(*by, F.col("sent").alias("at"), F.lit(False).alias("asks"), no_id.alias("notice_id"), "message_id"))
    w = Window.partitionBy(*by).orderBy("at", "asks", "message_id").rowsBetween(Window.unboundedPreceding, 0)
    newest = F.last(F.when(~F.col("asks"), F.struct(F.col("at").alias("sent"), "message_id")), ignorenulls=True).over(w)
    found = rows.withColumn("newest", newest).where(F.col("asks") & (at("newest.sent") > at("at") - width))
    found = found.select("notice_id", F.col("at").alias("seen"), F.col("key").alias("n_key"), "newest.message_id", "newest.sent")
    return _best(found.unionByName(n.select("notice_id", "seen"), allowMissingColumns=True))


def both(notices: DataFrame, messages: DataFrame) -> DataFrame:
    """Two streams as one, each row a notice or a message, for steps that take batches of both."""
    n, m = F.struct(*notices.columns), F.struct(*messages.columns)
    return notices.select(n.alias("notice")).unionByName(messages.select(m.alias("message")), allowMissingColumns=True)


def settle(spark: SparkSession, path: str, step: Callable[[DataFrame, int], None], days: int = 3, late: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """A step over batches of `both`: gives `step` what `matched` would give out, each notice in the batch that takes the watermark to its time.

    The folder of a batch has what it leaves: of its notices and messages, and of those before it, the notices that wait and the messages that a notice may
    still reach. The watermark is `late` behind the newest row of the side that is behind; rows of a later batch that lie behind it are dropped, and rows
    without a time are. A batch that comes again finds what the one before left, which goes only when the next batch is done.
    """
    sides = {"notice": ("seen_at", "seen", 0), "message": ("sent_at", "sent", days * DAY)}
    micros = lambda time: F.unix_micros(F.col(time))

    def run(batch: DataFrame, number: int) -> None:
        here, before, known, newest = f"{path}/{number}", f"{path}/{number - 1}", {}, []
        last = spark.read.schema("mark long").parquet(f"{before}/mark").head()[0] if number else None
        for side, (at, time, _) in sides.items():
            rows = batch.where(F.col(side).isNotNull()).select(f"{side}.*").withColumn(time, F.col(at).cast("timestamp")).where(F.col(time).isNotNull())
            if last is not None:
                rows = rows.where(micros(time) > last)
            if number:
                rows = rows.unionByName(batch.sparkSession.read.schema(rows.schema).parquet(f"{before}/{side}"))
            known[side] = rows
            newest.append(rows.agg((F.max(time) - F.expr(f"INTERVAL {late}")).alias("t")).select(micros("t")).head()[0])
        mark = last if None in newest else min(newest) if last is None else max(last, min(newest))
        for side, (_, time, back) in sides.items():
            (known[side] if mark is None else known[side].where(micros(time) > mark - back)).write.mode("overwrite").parquet(f"{here}/{side}")
        upto = F.lit(mark).cast("long")
        spark.range(1).select(upto.alias("mark")).write.mode("overwrite").parquet(f"{here}/mark")
        step(_met_in_time(known["notice"].where(micros("seen") <= upto), known["message"].where(micros("sent") <= upto), days), number)
        if number > 1:
            remove(spark, f"{path}/{number - 2}")

    return run
