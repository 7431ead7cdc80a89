"""Jobs through their stages: resumed, paused, cancelled and failed ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadline.operators import jobs


def test_jobs_go_through_their_stages(spark, tmp_path):
    ran = []

    def step(name, broken=()):
        def work(due):
            ids = sorted(r["job_id"] for r in due.collect())
            ran.append((name, ids))
            return due.select("job_id", F.lit(2).alias("found"), F.when(F.col("job_id").isin(*broken) if broken else F.lit(False), "x" * 2000).alias("error")).where("job_id <> 6")

        return jobs.Step(name, work)

    path = str(tmp_path / "jobs")
    first = [step("DEDUPING"), step("EXTRACTING", [3]), step("SALES_READY")]
    driver = jobs.JobDriver(spark, path, first, buckets=2)
    rows = [(1, "QUEUED", 0), (2, "RUNNING", 60), (3, "QUEUED", None), (4, "QUEUED", 0), (5, "RUNNING", 10), (6, "RUNNING", 30), (7, "COMPLETED", 100), (8, "PAUSED", 30)]
    driver.submit(spark.createDataFrame(rows, "job_id long, status string, progress int"))
    none = spark.createDataFrame([], "job_id long, action string")
    asked = {"EXTRACTING": [(4, "pause"), (4, "cancel"), (7, "cancel")], "DONE": [(5, "pause"), (1, "odd")]}
    driver.run(lambda stage: spark.createDataFrame(asked[stage], "job_id long, action string") if stage in asked else none)
    state = lambda: {r["job_id"]: (r["status"], r["stage"], r["progress"], dict(r["totals"])) for r in driver.state.read().collect()}
    assert ran == [("DEDUPING", [1, 3, 4, 5]), ("EXTRACTING", [1, 3, 5, 6]), ("SALES_READY", [1, 2, 5, 6])]
    got = state()
    assert got[1] == ("COMPLETED", "DONE", 100, {"DEDUPING": 2, "EXTRACTING": 2, "SALES_READY": 2}) and got[2] == ("COMPLETED", "DONE", 100, {"SALES_READY": 2})
    assert got[3] == ("FAILED", "EXTRACTING", 30, {"DEDUPING": 2}) and got[4] == ("CANCELLED", "DEDUPING", 30, {"DEDUPING": 2})
    assert got[5][:3] == ("PAUSED", "SALES_READY", 98) and got[6] == ("COMPLETED", "DONE", 100, {"EXTRACTING": 0, "SALES_READY": 0})
    assert got[7] == ("COMPLETED", None, 100, {}) and got[8] == ("PAUSED", None, 30, {})
    assert [len(r["error"]) for r in driver.state.read().where("status = 'FAILED'").collect()] == [1000]

    ran.clear()
    driver.run()  # nothing is left to do
    driver.submit(spark.createDataFrame(rows, "job_id long, status string, progress int"))  # all are known
    assert ran == [] and state() == got
    again = jobs.JobDriver(spark, path, first)  # another driver over the same state
    again.resume(spark.createDataFrame([(8,), (5,), (3,)], "job_id long"))
    again.run()
    assert ran == [("EXTRACTING", [8]), ("SALES_READY", [8])] and state()[8][:3] == ("COMPLETED", "DONE", 100) == state()[5][:3]


def test_a_driver_that_dies_goes_on(spark, tmp_path):
    ran = []

    def work(name, dies=False):
        def f(due):
            ran.append(name)
            if dies:
                raise RuntimeError("lost")
            return due.select("job_id", F.lit(1).alias("found"), F.lit(None).cast("string").alias("error"))

        return jobs.Step(name, f)

    path = str(tmp_path / "jobs")
    driver = jobs.JobDriver(spark, path, [work("DEDUPING"), work("EXTRACTING", dies=True)], buckets=2)
    driver.submit(spark.createDataFrame([(1, "QUEUED", 0)], "job_id long, status string, progress int"))
    try:
        driver.run()
    except RuntimeError:
        pass
    assert [(r["status"], r["progress"]) for r in driver.state.read().collect()] == [("RUNNING", 30)]
    jobs.JobDriver(spark, path, [work("DEDUPING"), work("EXTRACTING")]).run()
    assert ran == ["DEDUPING", "EXTRACTING", "EXTRACTING"] and [(r["status"], r["progress"]) for r in driver.state.read().collect()] == [("COMPLETED", 100)]
