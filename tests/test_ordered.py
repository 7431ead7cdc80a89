"""Places, running totals and ranks within groups, over ranges in place of one task."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from leadline.operators import ordered


def rows(n=3000):
    rng = random.Random(1)
    return [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(40) if rng.random() > 0.1 else None) for i in range(n)]


def test_places_are_those_of_one_sort(spark):
    data = rows()
    got = ordered.numbered(spark.createDataFrame(data, "id long, g string, v long"), F.col("v").desc_nulls_last(), "id").collect()
    want = sorted(data, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert {r["id"]: r["n"] for r in got} == {r[0]: i for i, r in enumerate(want, 1)}


def test_equal_rows_spread_over_ranges(spark):
    df = spark.createDataFrame([("same", 1)] * 4000 + [("z", 1)] * 10, "k string, v int").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    at = ordered.ranged(df, "k")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in at.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3500
    got = ordered.numbered(df, "k").collect()
    assert sorted(r["n"] for r in got) == list(range(1, 4011)) and min(r["n"] for r in got if r["k"] == "z") == 4001


def test_running_totals(spark):
    data = rows(1500)
    got = {r["id"]: r["total"] for r in ordered.running(spark.createDataFrame(data, "id long, g string, v long"), "v", "id").collect()}
    total = 0
    for i, _, v in data:
        total += v or 0
        assert got[i] == total


def test_ranks_in_groups_of_any_size(spark):
    data = rows()
    df = spark.createDataFrame(data, "id long, g string, v long")
    want, seen = {}, defaultdict(int)
    for r in sorted(data, key=lambda r: (str(r[1]), r[2] is None, r[2] or 0, r[0])):
        seen[r[1]] += 1
        want[r[0]] = seen[r[1]]
    got = {r["id"]: r["rank"] for r in ordered.ranked_in(df, ["g"], F.col("v").asc_nulls_last(), "id").collect()}
    assert got == want
    places = ordered.numbered(df, "g", "id", name="_place")
    split = ordered.grouped_join(places, df.groupBy("g").agg(F.count("*").alias("n")), ["g"], hot=100)
    assert {(r["id"], r["n"]) for r in split.collect()} == {(i, seen[g]) for i, g, _ in data}


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "`the.id` long, `a group` int")
    assert sorted(tuple(r) for r in ordered.ranked_in(df, ["a group"], "the.id").collect()) == [(i, i % 3, i // 3 + 1) for i in range(30)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, g string, v long")
    assert ordered.numbered(df, "id").collect() == [] and ordered.running(df, "v", "id").columns == ["id", "g", "v", "total"]
    assert ordered.ranked_in(df, ["g"], "id").collect() == []
