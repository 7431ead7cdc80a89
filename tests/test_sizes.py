"""Faults that only larger or other tables show, each on a small one."""

from __future__ import annotations

import os

import pytest

from leadline import plans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with the small tables, some of them replaced by the rows of SQL over the others."""

    def make(**replaced: str) -> str:
        for f in os.listdir(SMALL):
            name = f.removesuffix(".parquet")
            if f.endswith(".parquet"):
                spark.read.parquet(f"{SMALL}/{f}").createOrReplaceTempView(f"small_{name}")
                if name not in replaced:
                    os.symlink(f"{SMALL}/{f}", tmp_path / f)
        for name, rows in replaced.items():
            spark.sql(rows).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


def rows_of_sql(name: str, sf: str) -> list[tuple]:
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            path = f"{sf}/{f}/*.parquet" if os.path.isdir(f"{sf}/{f}") else f"{sf}/{f}"
            c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{path}')")
    got = c.execute(plans.ORACLE[name])
    names = [x[0] for x in got.description]
    return sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in got.fetchall()), key=str)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r[n] for n in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["sales_ready", "enrichment_state"])
def test_confidence_in_the_middle(spark, tables, name):
    """Balances of which a ten-thousandth lies between two thousandths, beside others that round to either."""
    balance = "case k % 4 when 0 then 5005.0 when 1 then 5004.0 when 2 then 5014.0 else 5015.0 end"
    sf = tables(
        customer=f"select c_custkey, c_name, 1 as c_nationkey, {balance.replace('k', 'c_custkey')} as c_acctbal, c_mktsegment from small_customer",
        supplier=f"select s_suppkey, s_name, s_nationkey, {balance.replace('k', 's_suppkey')} as s_acctbal from small_supplier",
    )
    assert rows_of(plans.QUERIES[name](spark, sf)) == rows_of_sql(name, sf)


def multiplied(df) -> list[str]:
    """Steps of the plan that ran which make rows of rows, or number them."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Generate" in line or "Window" in line]


def test_place_search_keeps_its_searches_as_a_list(spark, tables):
    """A job's 49 searches are no rows of their own, which a planner takes for as small as the jobs and sends to the driver; jobs that are there twice ask each
    search twice within their forty."""
    sf = tables(part="select p_partkey - p_partkey % 2 as p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from small_part union all select * from small_part where p_partkey % 3 = 0")
    df = plans.QUERIES["place_search"](spark, sf)
    assert not multiplied(df)
    assert rows_of(df) == rows_of_sql("place_search", sf)


def test_validation_history_is_of_all_jobs(spark):
    """Every check of every job is a row, and each contact's newest one its first."""
    from leadline.model import frame

    got = plans.QUERIES["validation_history"](spark, SMALL)
    assert got.count() == frame(spark, SMALL, "checks").count()
    assert got.where("age = 1").count() == frame(spark, SMALL, "checks").select("contact_id").distinct().count()


def test_job_results_are_of_all_jobs(spark):
    """Every company and contact stands on a page of its job, none of more than twenty."""
    from leadline.model import frame

    got = plans.QUERIES["job_results"](spark, SMALL)
    assert {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()} == {"company": frame(spark, SMALL, "companies").count(), "contact": frame(spark, SMALL, "contacts").count()}
    assert got.groupBy("job_id", "kind", "page").count().where("count > 20").isEmpty() and not got.where("page = 2").isEmpty()


def test_a_write_deals_rows_for_its_merge_alone(spark, tmp_path, monkeypatch):
    """What a write changed is told by sums of its buckets: rows are neither joined nor dealt by bucket; the same rows again leave nothing."""
    from leadline.sources.keyed import KeyedTable

    rows = spark.range(1000).selectExpr("cast(id as string) as k", "if(id % 3 = 0, null, id) as v")
    newest = lambda both: both.groupBy("k").max("v").withColumnRenamed("max(v)", "v")
    t = KeyedTable(spark, str(tmp_path / "t"), "k string, v long", "k", 4)
    for step in ("join", "repartition"):
        monkeypatch.setattr(type(rows), step, lambda *a, **k: pytest.fail("rows are dealt again"))
    assert [t.write(rows, newest), t.write(rows, newest), t.write(rows.where("k = '7'").withColumn("v", rows["v"] + 1), newest)] == [4, 0, 1]
    assert {x for x in os.listdir(tmp_path / "t") if not x.startswith(".")} == {"manifest-00000000", "manifest-00000001", "v0", "v1"}
    assert {r["k"]: r["v"] for r in t.read().collect()} == {str(i): 8 if i == 7 else None if i % 3 == 0 else i for i in range(1000)}


def test_jobs_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Lists of jobs that are small as files meet in sorted joins, in all stages of a driver's run."""
    from pyspark.sql import functions as F

    from leadline.operators import jobs

    joins, put = [], jobs.JobDriver._put

    def spied(self, rows):
        joins.extend(x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
        return put(self, rows)

    monkeypatch.setattr(jobs.JobDriver, "_put", spied)
    ids = spark.range(60).select(F.col("id").alias("job_id"))
    steps = [jobs.Step(n, lambda due: due.select("job_id", F.lit(1).alias("found"), F.lit(None).cast("string").alias("error"))) for n in ("DEDUPING", "EXTRACTING")]
    driver = jobs.JobDriver(spark, str(tmp_path / "jobs"), steps, buckets=2)
    driver.submit(ids.withColumn("status", F.lit("QUEUED")).withColumn("progress", F.lit(0)))
    driver.run(lambda stage: ids.where("job_id % 5 = 0").withColumn("action", F.lit("pause")))
    assert {r["status"]: r["count"] for r in driver.state.read().groupBy("status").count().collect()} == {"COMPLETED": 48, "PAUSED": 12}
    assert joins and not [x for x in joins if "Broadcast" in x]


def test_only_open_notices_are_put_in_order_of_time(spark, monkeypatch):
    """Notices with a reference or the mail system's id need no message by address, nor does the order of time hold messages to addresses of no open one."""
    from leadline import operators as op

    seen, latest = [], op.latest_before

    def spied(asks, facts, *rest):
        seen.append((asks.count(), facts.count()))
        return latest(asks, facts, *rest)

    monkeypatch.setattr(op, "latest_before", spied)
    n = spark.sql("select id as notice_id, if(id % 3 = 0, id, null) as ref, if(id % 3 = 1, 'g' || id, null) as gmail, 'A' || id || '@x.org' as email, timestamp '2024-01-02 00:00:00' as seen_at from range(90)")
    m = spark.sql("select id as message_id, 'g' || id as gmail_id, 'a' || id || '@X.org' as to_email, timestamp '2024-01-01 00:00:00' as sent_at from range(200)")
    assert {tuple(r) for r in op.match_notices(n, m).collect()} == {(i, i, i % 3 + 1) for i in range(90)}
    assert seen == [(30, 30)]


def test_pages_are_read_a_few_at_a_time(monkeypatch):
    """Of an Arrow batch only some pages' objects are held at once; null pages and empty batches have their rows."""
    import weakref

    import pyarrow as pa

    from leadline.sources import landed

    class Told(dict):
        pass

    read, refs, most = landed.structured, [], []

    def counted(html):
        out = Told(read(html))
        refs.append(weakref.ref(out))
        most.append(sum(r() is not None for r in refs))
        return out

    monkeypatch.setattr(landed, "structured", counted)
    page = '<script type="application/ld+json">{"@type": "JobPosting", "title": "t%d"}</script>'
    got = landed._structured(pa.array([None if i % 7 == 0 else page % i for i in range(700)]))
    assert [[j["title"] for j in r["jobs"]] for r in got.to_pylist()] == [[] if i % 7 == 0 else [f"t{i}"] for i in range(700)]
    assert max(most) <= landed.READ + 1 and len(landed._structured(pa.array([], pa.string()))) == 0
