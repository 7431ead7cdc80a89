"""Streams over the event table, run to the end of what is there and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline import streaming
from leadline.model import frame, sql
from leadline.plans.registry import query
from leadline.sources import table
from leadline.sources.shared import scratch, written
from leadline.streaming import deliveries, landing, matching, state


def events(spark: SparkSession, d: str) -> DataFrame:
    """The event table as a stream of files: those of its folder, or the one file that it is."""
    reader = spark.readStream.schema(table(spark, d, "events").schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{d}/events.parquet")
    return reader.option("pathGlobFilter", "events.parquet").parquet(d)


@query("""SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 AND event_type = 'view'""")
def event_feed(spark: SparkSession, d: str) -> DataFrame:
    """OP-T01, T03, T08, K08: events of one kind after a cursor into an append-only log, each once, though the step runs twice."""
    at = scratch(spark)
    feed = streaming.feed(events(spark, d), 100, key="event_type", value="view").select("event_id", "user_id", "event_type")
    step = streaming.into_log(f"{at}/log")
    twice = lambda batch, n: (step(batch, n), step(batch, n))[1]
    streaming.periodic(feed, twice, "dispatch", f"{at}/cursor", once=True).awaitTermination()
    return streaming.log(spark, f"{at}/log", feed.schema)


@query("""SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00'""")
def live_feed(spark: SparkSession, d: str) -> DataFrame:
    """OP-T02: a tenant's events from a time on, without what was before."""
    at = scratch(spark)
    feed = streaming.live(events(spark, d), F.expr("timestamp_ntz '2024-01-03 00:00:00'")).select("event_id", "event_type")
    streaming.periodic(feed, streaming.into_log(f"{at}/log"), "dispatch", f"{at}/cursor", once=True).awaitTermination()
    return streaming.log(spark, f"{at}/log", feed.schema)


def parts(rows: DataFrame, at: str, ends: list[str]) -> DataFrame:
    """rows with the part (0, 1, ...) in which each lands: by its time, the ends of the parts given."""
    part = F.lit(len(ends))
    for k, end in reversed(list(enumerate(ends))):
        part = F.when(F.col(at) < F.lit(end).cast("timestamp_ntz"), k).otherwise(part)
    return rows.withColumn("part", part)


LATE = """SELECT *, least(3, c + CASE WHEN event_id % 97 = 5 THEN 2 ELSE 0 END) AS part FROM (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-09' THEN 0 WHEN ts < TIMESTAMP '2024-01-17' THEN 1 WHEN ts < TIMESTAMP '2024-01-25' THEN 2 ELSE 3 END AS c FROM events)"""
KEPT = f"""SELECT e.*, mark IS NULL OR ts > date_trunc('millisecond', mark) AS kept FROM ({LATE}) e JOIN (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 3 DAY AS mark FROM ({LATE}) GROUP BY part) USING (part)"""


@query(f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM ({KEPT}) WHERE kept GROUP BY 1, 2 UNION ALL SELECT NULL, '(late)', count(*), NULL FROM ({KEPT}) WHERE NOT kept""")
def counts_with_late_events(spark: SparkSession, d: str) -> DataFrame:
    """OP-T09: daily counts of a stream that lands in four parts, some events two parts late: what is three days behind the newest event
    before its part is dropped, and counted under '(late)'. A heartbeat at the end closes the last windows."""
    at, e = scratch(spark), table(spark, d, "events")
    landed = parts(e, "ts", ["2024-01-09", "2024-01-17", "2024-01-25"])
    landed = written(landed.withColumn("part", F.least(F.lit(3), F.col("part") + F.when(F.col("event_id") % 97 == 5, 2).otherwise(0))))
    beat = e.agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"))
    beat = e.limit(0).unionByName(beat, allowMissingColumns=True)
    written(e.limit(0), f"{at}/in")  # the folder, before anything lands

    def start():
        counted = streaming.windowed_counts(spark.readStream.schema(e.schema).parquet(f"{at}/in"), window="1 day", late=streaming.HORIZON)
        counted = counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
        return counted.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/cursor").trigger(availableNow=True).start(f"{at}/out")

    told = landing.in_parts([{f"{at}/in": landed.where(F.col("part") == k).drop("part")} for k in range(4)] + [{f"{at}/in": beat}], start)
    late = spark.createDataFrame([(None, "(late)", landing.dropped(told, "dedupeWithinWatermark"), None)], "start timestamp_ntz, event_type string, n long, total double")
    return spark.read.schema(late.schema).parquet(f"{at}/out").union(late)


@query("""SELECT recipient, count(*) AS soft, count(*) >= 3 AS suppressed FROM (SELECT user_id::VARCHAR AS recipient FROM events WHERE event_type = 'error') GROUP BY 1""")
def soft_budget(spark: SparkSession, d: str) -> DataFrame:
    """OP-T04, A16: soft bounces by recipient as state of a stream, the last word on each."""
    at = scratch(spark)
    soft = events(spark, d).where("event_type = 'error'").select(F.col("user_id").cast("string").alias("recipient"), F.lit("soft").alias("kind"))
    kept = state.soft_bounces(soft)
    streaming.periodic(kept, streaming.into_log(f"{at}/log"), "bounces", f"{at}/cursor", once=True, mode="update").awaitTermination()
    rows = spark.read.schema("recipient string, soft long, suppressed boolean, batch long").parquet(f"{at}/log")
    return rows.groupBy("recipient").agg(F.max_by(F.struct("soft", "suppressed"), "batch").alias("x")).select("recipient", "x.*")


YEARS = ["1997-01-01", "1998-07-01", "2000-01-01"]


@query(sql("""SELECT message_id, 'delivered' AS state, sent_at + INTERVAL 3 HOUR AS at FROM messages WHERE status = 'sent' OR (status = 'bounced' AND message_id % 6 > 3) UNION ALL SELECT message_id, 'bounced', sent_at + to_hours((message_id % 6)::INT) FROM messages WHERE status = 'bounced'"""))
def delivery_timers(spark: SparkSession, d: str) -> DataFrame:
    """OP-T05, M19: of every message that was sent, delivered three hours later unless it bounced until then; bounces come nought to five hours
    after. The facts land in four parts, each a run of its own; timers are event time."""
    at = scratch(spark)
    m = frame(spark, d, "messages").where("status IN ('sent', 'bounced')")
    bounce = F.col("sent_at") + F.make_dt_interval(hours=F.col("message_id") % 6)
    sent = m.select(F.col("message_id").alias("id"), F.lit("sent").alias("kind"), F.col("sent_at").alias("at"))
    facts = sent.union(m.where("status = 'bounced'").select("message_id", F.lit("bounced"), bounce))
    landed = written(parts(facts, "at", YEARS))
    beat = landed.agg(F.lit(-1).cast("long").alias("id"), F.lit("bounced").alias("kind"), (F.max("at") + F.expr("INTERVAL 10 DAYS")).alias("at"))
    written(landed.drop("part").limit(0), f"{at}/in")

    def start():
        stream = spark.readStream.schema(facts.schema).parquet(f"{at}/in")
        return deliveries.delivered(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/cursor").trigger(availableNow=True).start(f"{at}/out")

    with landing.settings(spark, spark__sql__streaming__stateStore__providerClass=landing.ROCKSDB):
        landing.in_parts([{f"{at}/in": landed.where(F.col("part") == k).drop("part")} for k in range(len(YEARS) + 1)] + [{f"{at}/in": beat}], start)
    out = spark.read.schema(deliveries.OUT).parquet(f"{at}/out").where("id >= 0")
    return out.select(F.col("id").alias("message_id"), "state", F.timestamp_millis("ms").cast("timestamp_ntz").alias("at"))


NOTICES = """SELECT bounce_id AS notice_id, CASE WHEN message_id % 3 = 0 THEN message_id WHEN message_id % 3 = 2 AND message_id % 5 = 0 THEN -message_id END AS ref, CASE WHEN message_id % 3 = 1 THEN 'g' || message_id END AS gmail,
 CASE WHEN message_id % 7 = 3 THEN 'nobody@' || message_id || '.example' WHEN message_id % 7 <> 4 THEN upper(email) END AS email, detected_at + to_days(CASE WHEN message_id % 11 = 6 THEN 4 ELSE 0 END) AS seen_at FROM bounces"""


@query(sql(f"""SELECT notice_id, -x.m AS message_id, CASE WHEN x.t < 9 THEN x.t END AS tier FROM (SELECT notice_id, min(struct_pack(t := tier, a := -epoch_us(sent_at), m := -message_id)) AS x FROM (
 SELECT notice_id, sent_at, message_id, 1 AS tier FROM ({NOTICES}) n JOIN (SELECT *, CASE WHEN message_id % 2 = 0 THEN 'g' || message_id END AS gmail_id FROM messages WHERE sent_at IS NOT NULL) m
  ON n.ref = m.message_id AND sent_at <= seen_at AND sent_at > seen_at - INTERVAL 3 DAY
 UNION ALL SELECT notice_id, sent_at, m.message_id, 2 FROM ({NOTICES}) n JOIN (SELECT *, 'g' || message_id AS gmail_id FROM messages WHERE message_id % 2 = 0 AND sent_at IS NOT NULL) m ON n.gmail = m.gmail_id AND sent_at <= seen_at AND sent_at > seen_at - INTERVAL 3 DAY
 UNION ALL SELECT notice_id, sent_at, m.message_id, 3 FROM ({NOTICES}) n JOIN messages m ON lower(n.email) = lower(m.to_email) AND sent_at <= seen_at AND sent_at > seen_at - INTERVAL 3 DAY
 UNION ALL SELECT notice_id, NULL, NULL, 9 FROM ({NOTICES})) GROUP BY 1)"""))
def notice_stream(spark: SparkSession, d: str) -> DataFrame:
    """OP-J10, T03: notices and messages as two streams that land in four parts, each notice matched by reference, by the mail system's id or by
    address to a message of the three days before it; nulls where there is none."""
    at, k = scratch(spark), F.col("message_id")
    mailed = F.when(k % 2 == 0, F.concat(F.lit("g"), k)).alias("gmail_id")
    m = frame(spark, d, "messages").where("sent_at IS NOT NULL").select("message_id", "contact_id", mailed, "to_email", "sent_at", "bounced_at")
    messages = written(parts(m, "sent_at", YEARS), f"{at}/messages", "part")  # derived once: bounces are those of its rows
    n = frame(spark, d, "bounces", {"messages": messages}).select(
        F.col("bounce_id").alias("notice_id"),
        F.when(k % 3 == 0, k).when((k % 3 == 2) & (k % 5 == 0), -k).alias("ref"),
        F.when(k % 3 == 1, F.concat(F.lit("g"), k)).alias("gmail"),
        F.when(k % 7 == 3, F.concat(F.lit("nobody@"), k, F.lit(".example"))).when(k % 7 != 4, F.upper("email")).alias("email"),
        (F.col("detected_at") + F.make_dt_interval(days=F.when(k % 11 == 6, 4).otherwise(0))).alias("seen_at"),
    )
    m = m.drop("contact_id", "bounced_at")
    notices = written(parts(n, "seen_at", YEARS), f"{at}/notices", "part")
    last = messages.agg(F.max("sent_at").alias("t")).join(notices.agg(F.max("seen_at").alias("u")))  # one row each
    end = last.select((F.greatest("t", "u") + F.expr("INTERVAL 30 DAYS")).alias("at"))
    beats = {"n": n.limit(0).unionByName(end.select(F.lit(-1).cast("long").alias("notice_id"), F.col("at").alias("seen_at")), allowMissingColumns=True), "m": m.limit(0).unionByName(end.select(F.col("at").alias("sent_at")), allowMissingColumns=True)}
    beats = {f"{at}/{name}": written(df) for name, df in beats.items()}  # before what they rest on is moved
    for name, df in (("n", n), ("m", m)):
        written(df.limit(0), f"{at}/{name}")

    def start():
        stream = lambda name, df: spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{at}/{name}")
        step = matching.settle(spark, f"{at}/known", streaming.into_log(f"{at}/out"))
        return streaming.periodic(matching.both(stream("n", n), stream("m", m)), step, "bounces", f"{at}/cursor", once=True)

    some = [{f"{at}/n": landing.moved(spark, f"{at}/notices/part={i}"), f"{at}/m": landing.moved(spark, f"{at}/messages/part={i}")} for i in range(len(YEARS) + 1)]
    landing.in_parts([*some, beats], start)
    return spark.read.schema("notice_id long, message_id long, tier int").parquet(f"{at}/out").select("notice_id", "message_id", "tier").where("notice_id >= 0")
