"""Queries on stored tables: upserts that go on where the last run ended, and answers that are looked up before they are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline import operators as op
from leadline.model import frame, frames, sql
from leadline.operators import jobs
from leadline.plans.registry import query
from leadline.sources.keyed import KeyedTable, ResultCache
from leadline.sources.shared import scratch, written


@query(sql("""SELECT key, source_name, coalesce(urls, '') AS urls, CASE level WHEN 2 THEN 'red' WHEN 1 THEN 'amber' ELSE 'green' END AS posture, CASE WHEN n > 1 THEN 'merged' ELSE 'unique' END AS dedupe_status FROM (SELECT key, arg_min(source_name, sighting_id) AS source_name, max(CASE posture WHEN 'red' THEN 2 WHEN 'amber' THEN 1 ELSE 0 END) AS level, count(DISTINCT sighting_id) AS n FROM (SELECT *, CASE WHEN company_id % 10 <> 0 THEN 'id:' || company_id ELSE 'row:' || sighting_id END AS key FROM sightings) GROUP BY 1)
 LEFT JOIN (SELECT key, string_agg(source_url, ',' ORDER BY o) AS urls FROM (SELECT CASE WHEN company_id % 10 <> 0 THEN 'id:' || company_id ELSE 'row:' || sighting_id END AS key, source_url, min(sighting_id) AS o FROM sightings WHERE source_url IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (key)"""))
def company_store(spark: SparkSession, d: str) -> DataFrame:
    """OP-J14, M01: sightings arrive in three batches, the second one twice, and are upserted by key into a stored table: the first one's values, all
    addresses in the order they were seen in, the worst posture, and whether several met."""
    s = frame(spark, d, "sightings")
    rows = op.company_rows(s.withColumn("key", F.when(F.col("company_id") % 10 != 0, F.concat(F.lit("id:"), "company_id")).otherwise(F.concat(F.lit("row:"), "sighting_id"))))
    store = KeyedTable(spark, f"{scratch(spark)}/companies", op.COMPANY, "key")
    batch = lambda k: rows.where(F.pmod(F.xxhash64(F.col("first").cast("string")), F.lit(3)) == k)
    for k in (0, 2, 2, 1):
        store.write(batch(k), op.merge_companies)
    return op.company_view(store.read())


@query(sql("""SELECT round, contact_id, namespace, hit, answer FROM (SELECT 1 AS round, contact_id, namespace, false AS hit FROM contacts, (VALUES ('lookup'), ('verify')) v(namespace) WHERE contact_id % 2 = 0
 UNION ALL SELECT 2, contact_id, namespace, namespace = 'lookup' AND contact_id % 2 = 0 FROM contacts, (VALUES ('lookup'), ('verify')) v(namespace) WHERE contact_id % 3 = 0
 UNION ALL SELECT 3, contact_id, namespace, namespace = 'lookup' AND contact_id % 3 = 0 AND contact_id % 2 <> 0 FROM contacts, (VALUES ('lookup'), ('verify')) v(namespace) WHERE contact_id % 5 <> 1)
 JOIN (SELECT contact_id, CASE WHEN contact_id % 4 <> 3 THEN lower(coalesce(email, full_name)) END AS answer FROM contacts) USING (contact_id)"""))
def cached_lookups(spark: SparkSession, d: str) -> DataFrame:
    """OP-I27: contacts asked for in three rounds, 30 and 100 days after the first, through stored answers that hold 90 days (lookups) and 30 (verifications);
    'no answer' is an answer too. A question that is no hit is asked, once."""
    cache = ResultCache(spark, f"{scratch(spark)}/cache")
    c = written(frame(spark, d, "contacts").select("contact_id", "company_id", F.lower(F.coalesce("email", "full_name")).alias("said")))
    both = c.withColumn("namespace", F.explode(F.array(F.lit("lookup"), F.lit("verify"))))
    asked = both.select(cache.key(F.col("namespace"), F.col("company_id"), F.col("contact_id")).alias("key"), "namespace", "contact_id", "said")
    provider = lambda q: q.where("contact_id % 4 <> 3").select("key", F.col("said").alias("answer"))
    out = None
    for k, (days, who) in enumerate(((0, "contact_id % 2 = 0"), (30, "contact_id % 3 = 0"), (100, "contact_id % 5 <> 1")), 1):
        now = F.expr(f"timestamp '2024-01-01 00:00:00' + INTERVAL {days} DAYS")
        got = cache.through(asked.where(who), now, provider).select(F.lit(k).alias("round"), "contact_id", "namespace", "hit", "answer")
        out = got if out is None else out.union(got)
    return out


#: Of an active job: whether a control stops it, and where.
STEPS = (("DEDUPING", 30), ("EXTRACTING", 60), ("ENRICHING", 72), ("VALIDATING", 85), ("SALES_READY", 98))
COUNTS = {
    "DEDUPING": "SELECT job_id, count(*) AS n FROM companies GROUP BY 1",
    "EXTRACTING": "SELECT job_id, count(*) AS n FROM contacts GROUP BY 1",
    "ENRICHING": "SELECT job_id, count(*) AS n FROM contacts WHERE email IS NOT NULL GROUP BY 1",
    "VALIDATING": "SELECT job_id, count(*) AS n FROM contacts WHERE final_email_status = 'VERIFIED' GROUP BY 1",
    "SALES_READY": "SELECT job_id, count(*) AS n FROM leads GROUP BY 1",
}


def _runs_sql() -> str:
    def step(source: str, k: int) -> str:
        name, ends = STEPS[k]
        stopped = "CASE WHEN status IN ('QUEUED', 'RUNNING') AND job_id % 13 = 5 THEN 'CANCELLED'" + (" WHEN status IN ('QUEUED', 'RUNNING') AND job_id % 11 = 3 THEN 'PAUSED'" if k >= 2 else "") + " ELSE status END"
        due = f"s IN ('QUEUED', 'RUNNING') AND progress < {ends}"
        fails = f"{due} AND job_id % 17 = 4" if name == "VALIDATING" else "false"
        return f"SELECT job_id, CASE WHEN {fails} THEN 'FAILED' WHEN {due} THEN 'RUNNING' ELSE s END AS status, CASE WHEN {due} THEN '{name}' ELSE stage END AS stage, CASE WHEN {due} AND NOT ({fails}) THEN {ends} ELSE progress END AS progress, CASE WHEN {due} AND NOT ({fails}) THEN totals || [('{name}=' || coalesce(n, 0))] ELSE totals END AS totals FROM (SELECT *, {stopped} AS s FROM ({source})) LEFT JOIN ({COUNTS[name]}) USING (job_id)"

    out = "SELECT job_id, status, NULL::VARCHAR AS stage, progress, []::VARCHAR[] AS totals FROM jobs"
    for k in range(len(STEPS)):
        out = step(out, k)
    ends = "CASE WHEN status IN ('QUEUED', 'RUNNING') AND job_id % 13 = 5 THEN 'CANCELLED' WHEN status IN ('QUEUED', 'RUNNING') AND job_id % 11 = 3 THEN 'PAUSED' WHEN status IN ('QUEUED', 'RUNNING') AND progress >= 98 THEN 'COMPLETED' ELSE status END"
    return f"SELECT job_id, f AS status, CASE WHEN f = 'COMPLETED' AND status <> 'COMPLETED' THEN 'DONE' ELSE stage END AS stage, CASE WHEN f = 'COMPLETED' AND status <> 'COMPLETED' THEN 100 ELSE progress END::INT AS progress, CASE WHEN stage = 'VALIDATING' AND f = 'FAILED' THEN 'no verifier' END AS error, array_to_string(list_sort(totals), ';') AS totals FROM (SELECT *, {ends} AS f FROM ({out}))"


@query(sql(_runs_sql()))
def job_runs(spark: SparkSession, d: str) -> DataFrame:
    """OP-M23: every job through its stages from where it stands, all jobs of a stage at once, with what each stage found; some are cancelled before the first
    stage, some paused before the third, some fail in the fourth. The driver is run twice, the second time to no effect."""
    t = frames(spark, d, ["companies", "contacts", "leads", "jobs"], ["companies", "contacts"])
    counted = {"DEDUPING": t["companies"], "EXTRACTING": t["contacts"], "ENRICHING": t["contacts"].where("email IS NOT NULL"), "VALIDATING": t["contacts"].where("final_email_status = 'VERIFIED'"), "SALES_READY": t["leads"]}

    def work(stage: str):
        def found(jobs: DataFrame) -> DataFrame:
            n = counted[stage].join(jobs.hint("merge"), "job_id", "left_semi").groupBy("job_id").agg(F.count("*").alias("found"))
            error = F.when((F.lit(stage) == "VALIDATING") & (F.col("job_id") % 17 == 4), "no verifier")
            return jobs.join(n.hint("merge"), "job_id", "left").select("job_id", F.coalesce("found", F.lit(0)).alias("found"), error.alias("error"))

        return found

    driver = jobs.JobDriver(spark, f"{scratch(spark)}/jobs", [jobs.Step(name, work(name)) for name, _ in STEPS], buckets=4)
    driver.submit(t["jobs"].select("job_id", "status", "progress"))
    ids = t["jobs"].select("job_id")
    cancelled = ids.where("job_id % 13 = 5").withColumn("action", F.lit("cancel"))
    paused = ids.where("job_id % 11 = 3").withColumn("action", F.lit("pause"))
    early = ("DEDUPING", "EXTRACTING")
    for _ in range(2):
        driver.run(lambda stage: cancelled if stage in early else cancelled.union(paused))
    totals = F.array_join(F.array_sort(F.transform(F.map_entries("totals"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return driver.state.read().select("job_id", "status", "stage", "progress", "error", totals.alias("totals"))
