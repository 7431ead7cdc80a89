"""Stored tables by key: only what changes is written, a write again changes nothing; answers that expire."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from leadline import operators as op
from leadline.sources.keyed import Conflict, KeyedTable, ResultCache

LARGEST = lambda both: both.groupBy("k").agg(F.max("v").alias("v"))


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v long")


def content(table, version=None):
    return {r["k"]: r["v"] for r in table.read(version).collect()}


def test_only_changed_buckets_are_written(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k string, v long", "k", 8)
    assert content(t) == {} and t.write(rows(spark, []), LARGEST) == 0 and t.versions() == []
    first = [(f"k{i}", i) for i in range(100)]
    assert t.write(rows(spark, [*first, ("k5", 3)]), LARGEST) == 8
    assert content(t) == dict(first)
    assert t.write(rows(spark, first), LARGEST) == 0 and t.versions() == [0]  # nothing new, nothing written
    assert t.write(rows(spark, [("k7", 700), ("k8", 1)]), LARGEST) == 1
    assert t.versions() == [0, 1] and content(t)["k7"] == 700 and content(t, 0)["k7"] == 7
    assert len(glob.glob(str(tmp_path / "t" / "v1" / "_bucket=*"))) == 1
    again = KeyedTable(spark, str(tmp_path / "t"), "k string, v long", "k", 99)  # the first write fixed the buckets
    assert again.write(rows(spark, [("new", 1)]), LARGEST) == 1 and content(again)["new"] == 1
    assert {r["k"] for r in again.find(spark.createDataFrame([("k7",), ("k7",), ("none",)], "k string")).collect()} == {"k7"}
    before = content(t)
    t.clean()
    assert t.versions() == [2] and content(t) == before
    held = {(v, b) for b, v in t.manifest()["at"].items()}
    assert {(int(p.split("/v")[-1].split("/")[0]), p.split("=")[-1]) for p in glob.glob(str(tmp_path / "t" / "v*" / "_bucket=*"))} == held


def test_keys_that_a_merge_leaves_out_go(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k string, v long", "k", 2)
    t.write(rows(spark, [("a", 1), ("b", 2), ("c", 3)]), LARGEST)
    gone = lambda both: both.where("v > 1").dropDuplicates(["k"])
    assert t.write(rows(spark, [("a", 1)]), gone) == 1 and content(t) == {"b": 2, "c": 3}
    assert t.write(rows(spark, [("b", 2), ("c", 3)]), lambda both: both.limit(0)) >= 1 and content(t) == {}


def test_of_two_writers_one_fails(spark, tmp_path):
    one = KeyedTable(spark, str(tmp_path / "t"), "k string, v long", "k", 2)
    one.write(rows(spark, [("a", 1)]), LARGEST)
    open(tmp_path / "t" / "manifest-00000001", "w").close()
    other = KeyedTable(spark, str(tmp_path / "t"), "k string, v long", "k", 2)
    other.versions = lambda: [0]  # it looked before the other was done
    with pytest.raises(Conflict):
        other.write(rows(spark, [("a", 2)]), LARGEST)
    os.remove(tmp_path / "t" / "manifest-00000001")
    assert content(one) == {"a": 1}
    one.clean()
    assert not glob.glob(str(tmp_path / "t" / "v1")) and content(one) == {"a": 1}


def test_companies_merge_the_same_in_any_order(spark, tmp_path):
    s = spark.createDataFrame([("k", 3, "c", "u1", "green"), ("k", 1, "a", "u2", "amber"), ("k", 2, "b", "u1", "green"), ("x", 9, "z", None, "red")], "key string, sighting_id long, source_name string, source_url string, posture string")
    want = {("k", "a", "u2,u1", "amber", "merged"), ("x", "z", "", "red", "unique")}
    for n, order in enumerate(([1, 3], [2, 9], [1]), 1):
        t = KeyedTable(spark, str(tmp_path / "t"), op.COMPANY, "key", 4)
        t.write(op.company_rows(s.where(F.col("sighting_id").isin(order))), op.merge_companies)
    assert {tuple(r) for r in op.company_view(t.read()).collect()} == want
    assert t.write(op.company_rows(s), op.merge_companies) == 0


def test_answers_expire(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "c"), buckets=2)
    q = spark.createDataFrame([("lookup", " Ann ", 1), ("lookup", "ann", 1), ("lookup", "bo", 2), ("verify", "bo", 2)], "namespace string, who string, n long")
    q = q.withColumn("key", cache.key(F.col("namespace"), F.col("who"), F.lit(None), F.col("n")))
    day = lambda n: F.expr(f"timestamp '2024-01-01 00:00:00' + INTERVAL {n} DAYS")
    asked = []

    def provider(x):
        asked.append(sorted((r["namespace"], r["who"].strip().lower()) for r in x.collect()))
        return x.where("trim(lower(who)) = 'ann'").select("key", F.lit("a!").alias("answer"))

    run = lambda n: {(r["namespace"], r["who"], r["hit"], r["answer"]) for r in cache.through(q, day(n), provider).collect()}
    assert run(0) == {("lookup", " Ann ", False, "a!"), ("lookup", "ann", False, "a!"), ("lookup", "bo", False, None), ("verify", "bo", False, None)}
    assert run(29) == {("lookup", " Ann ", True, "a!"), ("lookup", "ann", True, "a!"), ("lookup", "bo", True, None), ("verify", "bo", True, None)}
    assert ("verify", "bo", False, None) in run(30) and ("lookup", "bo", True, None) in run(89)
    assert {(n, hit) for n, _, hit, _ in run(91)} == {("lookup", False), ("verify", True)}
    assert asked == [[("lookup", "ann"), ("lookup", "bo"), ("verify", "bo")], [], [("verify", "bo")], [("verify", "bo")], [("lookup", "ann"), ("lookup", "bo")]]
    assert cache.compact(day(500)) >= 1 and cache.table.read().count() == 0 and cache.compact(day(500)) == 0
