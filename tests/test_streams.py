"""Timers, joins of two streams and late events, over several runs of a query, against rules over the whole table."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline import plans, streaming
from leadline.operators import match_notices
from leadline.sources.shared import exists
from leadline.streaming import deliveries, landing, matching

T0 = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)
FACTS = "id long, kind string, at timestamp"


def after(hours):
    return T0 + datetime.timedelta(hours=hours)


def run(spark, tmp_path, parts, build, folders, rocks=False, mode="append"):
    """Lands parts (name -> rows) one by one and runs build(streams) after each; the rows of the output and the progress of all runs."""
    for name, schema in folders.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))

    def start():
        streams = {n: spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in folders.items()}
        return build(streams).writeStream.format("parquet").outputMode(mode).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))

    def go():
        return landing.in_parts([{str(tmp_path / n): spark.createDataFrame(rows, folders[n]).coalesce(1) for n, rows in p.items()} for p in parts], start)

    if rocks:
        with landing.settings(spark, spark__sql__streaming__stateStore__providerClass=landing.ROCKSDB):
            told = go()
    else:
        told = go()
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()], told


def test_timers_over_several_runs(spark, tmp_path):
    facts = [
        [(1, "sent", after(0)), (2, "sent", after(0)), (3, "sent", after(1)), (6, "bounced", after(1.5)), (7, "bounced", after(1))],
        [(2, "bounced", after(2)), (4, "sent", after(2)), (3, "bounced", after(4)), (6, "sent", after(1)), (2, "sent", after(0))],  # 3 at its last moment, 6 out of order
        [(5, "sent", after(8)), (1, "bounced", after(30)), (4, "bounced", after(5.5))],  # 1 long delivered, 4 after its due time
        [(8, "sent", after(40)), (8, "bounced", after(41)), (8, "bounced", after(42))],
        [(99, "bounced", after(300))],
    ]
    got, told = run(spark, tmp_path, [{"f": f} for f in facts], lambda s: deliveries.delivered(s["f"], late="12 hours"), {"f": FACTS}, rocks=True)
    want = deliveries.delivered_at_once(spark.createDataFrame(sum(facts, []), FACTS)).collect()
    assert sorted(r for r in got if r[0] < 99) == sorted(tuple(r) for r in want if r["id"] < 99)
    assert {r[:2] for r in got} >= {(1, "delivered"), (1, "bounced"), (4, "delivered"), (4, "bounced"), (5, "delivered")} and (3, "delivered") not in {r[:2] for r in got}
    assert len(told) > len(facts)  # runs with batches of their own for timers


def test_timers_of_many_messages(spark, tmp_path):
    rng = random.Random(4)
    facts = []
    for i in range(400):
        at = rng.uniform(0, 200)
        facts.append((i, "sent", after(at)))
        if rng.random() < 0.4:
            facts.append((i, "bounced", after(at + rng.uniform(0, 6))))
    parts = [[f for f in facts if after(50 * k) <= f[2] < after(50 * k + 50)] for k in range(5)] + [[(1000, "bounced", after(900))]]
    got, _ = run(spark, tmp_path, [{"f": f} for f in parts], lambda s: deliveries.delivered(s["f"]), {"f": FACTS}, rocks=True)
    want = deliveries.delivered_at_once(spark.createDataFrame(facts, FACTS)).collect()
    assert sorted(r for r in got if r[0] < 1000) == sorted(tuple(r) for r in want)


def test_notices_meet_messages(spark, tmp_path):
    rng = random.Random(9)
    messages = [(i, f"g{i}" if i % 2 else None, f"P{i % 40}@x.org", after(rng.uniform(0, 700))) for i in range(1, 500)]
    notices = []
    for i in range(1, 300):
        m = rng.choice(messages)
        seen = m[3] + datetime.timedelta(hours=rng.uniform(0, 60))
        ref, gmail = (m[0] if i % 4 == 0 else -m[0] if i % 4 == 1 else None), (m[1] if i % 3 == 0 else None)
        notices.append((i, ref, gmail, m[2].lower() if i % 5 else None, seen))
    notices += [(900, None, None, None, after(30)), (901, 77_777, "none", "nobody@x.org", after(31))]
    n, m = "notice_id long, ref long, gmail string, email string, seen_at timestamp", "message_id long, gmail_id string, to_email string, sent_at timestamp"
    cut = lambda rows, k: [r for r in rows if after(200 * k) <= r[-1] < after(200 * k + 200)]
    parts = [{"n": cut(notices, k), "m": cut(messages, k)} for k in range(4)]
    parts.append({"n": [(-1, None, None, None, after(2000))], "m": [(-1, None, None, after(2000))]})
    got, told = run(spark, tmp_path, parts, lambda s: matching.matched(s["n"], s["m"]), {"n": n, "m": m})
    want = match_notices(spark.createDataFrame(notices, n), spark.createDataFrame(messages, m)).collect()
    assert sorted(r for r in got if r[0] > 0) == sorted(tuple(r) for r in want)
    assert (900, None, None) in got and (901, None, None) in got
    assert landing.kept_rows(told) < 10  # nothing older than three days is held


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    parts = [
        [(1, after(0), "a", 1.0), (2, after(100), "a", 2.0), (2, after(100), "a", 2.0)],
        [(3, after(27), "a", 4.0), (4, after(29), "a", 8.0), (5, after(1), "b", 16.0), (6, after(150), "b", 32.0)],  # the mark is at 28
        [(7, after(78), "a", 64.0), (8, after(79), "b", 128.0), (9, after(27.5), "c", 1.0)],  # the mark is at 78
        [(-1, after(2000), "beat", 0.0)],
    ]
    build = lambda s: streaming.windowed_counts(s["e"], window="1 day").select("event_type", "n", "total", F.col("window.start").alias("s"))
    got, told = run(spark, tmp_path, [{"e": p} for p in parts], build, {"e": schema})
    assert sorted(r[:3] for r in got) == [("a", 1, 1.0), ("a", 1, 2.0), ("a", 1, 8.0), ("b", 1, 32.0), ("b", 1, 128.0)]
    assert landing.dropped(told, "dedupeWithinWatermark") == 4 == landing.dropped(told)


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ZeroDivisionError), landing.settings(spark, spark__sql__shuffle__partitions="3", spark__leadline__odd="1"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        1 / 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("spark.leadline.odd", None) is None


def test_log_of_batches(spark, tmp_path):
    kind = T.StructType([T.StructField("k", T.LongType())])
    step, path = streaming.into_log(str(tmp_path / "log")), str(tmp_path / "log")
    df = lambda *x: spark.createDataFrame([(v,) for v in x], kind)
    step(df(1, 2), 0)
    step(df(1, 2), 0)
    step(df(3), 1)
    assert sorted(r["k"] for r in streaming.log(spark, path, kind).collect()) == [1, 2, 3]


def test_steps_run_again_and_again(spark, tmp_path):
    """A running query takes what lands between its ticks, a batch each, and goes on from its checkpoint after it is stopped."""
    import time

    kind = T.StructType([T.StructField("k", T.LongType())])
    path, log, at = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "at")
    land = lambda k: spark.createDataFrame([(k,)], kind).write.mode("append").parquet(path)
    seen = lambda: sorted(r["k"] for r in streaming.log(spark, log, kind).collect())
    land(1)

    def until(n):
        for _ in range(150):
            time.sleep(0.2)
            if exists(spark, log) and len(seen()) >= n:
                return
        raise AssertionError(seen())

    q = streaming.periodic(spark.readStream.schema(kind).parquet(path), streaming.into_log(log), "dispatch", at, seconds=0.5)
    until(1)
    land(2)
    until(2)
    q.stop()
    land(3)
    q = streaming.periodic(spark.readStream.schema(kind).parquet(path), streaming.into_log(log), "dispatch", at, seconds=0.5)
    until(3)
    q.stop()
    assert seen() == [1, 2, 3]
    batches = spark.read.parquet(log).select("batch").distinct().count()
    assert batches == 3


def test_messages_in_flight_share_state(spark, tmp_path):
    """Thousands of messages in flight at once are one row of state for each share of the ids."""
    facts = [(i, "sent", after(i % 2)) for i in range(10_000)] + [(i, "bounced", after(2)) for i in range(0, 10_000, 5)]
    got, told = run(spark, tmp_path, [{"f": facts}, {"f": [(99_999, "bounced", after(900))]}], lambda s: deliveries.delivered(s["f"]), {"f": FACTS}, rocks=True)
    want = deliveries.delivered_at_once(spark.createDataFrame(facts, FACTS)).collect()
    assert sorted(r for r in got if r[0] < 99_999) == sorted(tuple(r) for r in want)
    assert max(o["numRowsTotal"] for p in told for o in p["stateOperators"]) <= 1024


NOTICE = "notice_id long, ref long, gmail string, email string, seen_at timestamp"
MESSAGE = "message_id long, gmail_id string, to_email string, sent_at timestamp"


def test_notices_settle_by_batch(spark, tmp_path):
    """A batch that comes again changes nothing, a notice waits for its batch, late rows are dropped, and only what can still be reached is kept."""
    rng = random.Random(5)
    messages = [(i, f"g{i}" if i % 2 else None, f"P{i % 20}@x.org", after(rng.uniform(0, 400))) for i in range(1, 300)]
    notices = []
    for i in range(1, 200):
        m = rng.choice(messages)
        notices.append((i, m[0] if i % 4 == 0 else None, m[1] if i % 3 == 0 else None, m[2].lower() if i % 5 else None, m[3] + datetime.timedelta(hours=rng.uniform(0, 60))))
    cut = lambda rows, k: [r for r in rows if after(100 * k) <= r[-1] < after(100 * k + 100)]
    parts = [([], cut(messages, 0))] + [(cut(notices, k), cut(messages, k + 1)) for k in range(5)]
    parts.append(([(-1, None, None, None, after(2000)), (800, None, None, None, None)], [(-1, None, None, after(2000))]))
    parts.append(([(900, 1, None, None, after(30))], []))  # late
    step = matching.settle(spark, str(tmp_path / "known"), streaming.into_log(str(tmp_path / "out")))
    for k, (n, m) in enumerate(parts):
        batch = matching.both(spark.createDataFrame(n, NOTICE), spark.createDataFrame(m, MESSAGE))
        step(batch, k)
        step(batch, k)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()
    want = match_notices(spark.createDataFrame(notices, NOTICE), spark.createDataFrame(messages, MESSAGE)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert spark.read.parquet(str(tmp_path / "known" / str(len(parts) - 1) / "message")).count() == 1
    assert not exists(spark, str(tmp_path / "known" / "0"))


def test_notice_stream_holds_no_rows_in_memory(spark, monkeypatch):
    told, former = [], landing.in_parts
    monkeypatch.setattr(landing, "in_parts", lambda *a: told.append(former(*a)) or told[-1])
    plans.QUERIES["notice_stream"](spark, "/root/testdata/sf0.001")
    assert told[0] and sum(o["numRowsTotal"] for p in told[0] for o in p["stateOperators"]) == 0


def most_rows(spark, run) -> int:
    """Rows that the step of most rows gave out, of all plans that ran in run()."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    listed = lambda: (lambda x: [x.apply(i) for i in range(x.size())])(store.executionsList())
    bus.waitUntilEmpty()
    last, most = max((e.executionId() for e in listed()), default=-1), 0
    run()
    bus.waitUntilEmpty()
    for e in listed():
        if e.executionId() > last:
            told, metrics = store.executionMetrics(e.executionId()), e.metrics()
            named = [m for m in (metrics.apply(i) for i in range(metrics.size())) if m.name() == "number of output rows"]
            most = max([most] + [int(told.apply(m.accumulatorId()).replace(",", "")) for m in named if told.contains(m.accumulatorId())])
    return most


def test_notices_of_one_address_make_no_pairs(spark, tmp_path):
    """Thousands of messages and notices of one address are put in order of time, not met pair by pair; three days are over to the moment, and of messages
    of one time the greatest counts."""
    messages = [(i, None, "Info@x.org", after(i % 240)) for i in range(1, 2000)]
    notices = [(i, None, None, "info@X.org", after(i % 300 + i % 2 / 2)) for i in range(1, 2000)]
    old = -500_000  # before 1970
    messages += [(3000 + i, None, f"old{i}@x.org", after(old + 24 * i)) for i in range(40)]
    notices += [(3000 + i, None, None, f"OLD{i}@x.org", after(old + 24 * i + 72) - datetime.timedelta(microseconds=i % 2)) for i in range(40)]
    notices += [(4000 + i, 3000 + i, None, None, after(old + 24 * i) - datetime.timedelta(microseconds=i % 2)) for i in range(40)]
    beat = [(-1, None, None, None, after(2000))], [(-1, None, None, after(2000))]
    step = matching.settle(spark, str(tmp_path / "known"), streaming.into_log(str(tmp_path / "out")))

    def run():
        for k, (n, m) in enumerate([(notices, messages), beat]):
            step(matching.both(spark.createDataFrame(n, NOTICE), spark.createDataFrame(m, MESSAGE)), k)

    most = most_rows(spark, run)
    hours = lambda i: i % 300 + i % 2 / 2
    want = {}
    for i in range(1, 2000):
        last = min(int(hours(i)), 239)
        want[i] = (max(m for m in range(1, 2000) if m % 240 == last), 3) if last > hours(i) - 72 else (None, None)
    for i in range(40):
        want[3000 + i] = (3000 + i, 3) if i % 2 else (None, None)
        want[4000 + i] = (None, None) if i % 2 else (3000 + i, 1)
    assert {r["notice_id"]: (r["message_id"], r["tier"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    assert len(messages) < most < 10 * len(messages)


def test_notice_stream_derives_messages_once(spark, monkeypatch):
    """Bounces are those of the messages that were written, and what a part holds lands as it was written."""
    from leadline.plans import feeds

    derived, former = [], feeds.frame
    monkeypatch.setattr(feeds, "frame", lambda spark, d, name, held=None: derived.append((name, sorted(held or {}))) or former(spark, d, name, held))
    got = plans.QUERIES["notice_stream"](spark, "/root/testdata/sf0.001")
    assert derived == [("messages", []), ("bounces", ["messages"])]
    assert got.count() == former(spark, "/root/testdata/sf0.001", "bounces").count()
