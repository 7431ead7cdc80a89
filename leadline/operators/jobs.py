"""Jobs driven through their stages, all jobs of a stage at once, from where each stands.

The state of every job is a row of a stored table, which is written after each stage: a driver that dies goes on with the next stage, and running
it again changes nothing. Between stages it asks which jobs were paused or cancelled meanwhile; those stay where they are. A stage is a function
from jobs to what it found for each, or why it failed; one job's failure is no other's. Jobs meet jobs in sorted joins, as a list of jobs can be
small as a file and large in the driver, through which a broadcast goes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.sources.keyed import KeyedTable
from leadline.sources.shared import remove, scratch, written

#: The stages of a job in their order, and how far it is, in percent, at the end of each.
STAGES = {"RESOLVING_LOCATION": 5, "DISCOVERING": 20, "DEDUPING": 30, "CRAWLING": 45, "EXTRACTING": 60, "ENRICHING": 72, "VALIDATING": 85, "SYNCING": 93, "SALES_READY": 98, "DONE": 100}
#: States of jobs that go on, and what a control makes of them.
ACTIVE = ("QUEUED", "RUNNING")
CONTROLS = {"pause": "PAUSED", "cancel": "CANCELLED"}
STATE = "job_id long, status string, stage string, progress int, error string, totals map<string,long>, seq long"


@dataclass(frozen=True)
class Step:
    """A stage that does something: it ends at the stage's percentage. work gives (job_id, found, error) of jobs (job_id); a job that it
    leaves out has found nothing."""

    stage: str
    work: Callable[[DataFrame], DataFrame]

    @property
    def ends(self) -> int:
        return STAGES[self.stage]


class JobDriver:
    def __init__(self, spark: SparkSession, path: str, steps: list[Step], buckets: int = 8):
        self.spark, self.steps = spark, steps
        self.state = KeyedTable(spark, path, STATE, "job_id", buckets)

    def _put(self, rows: DataFrame) -> int:
        newest = lambda both: both.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in self.state.schema.names if c != "job_id"]), "seq").alias("x")).select("job_id", "x.*")
        return self.state.write(rows, newest)

    def submit(self, jobs: DataFrame) -> None:
        """Jobs (job_id, status, progress) that aren't known yet."""
        new = jobs.join(self.state.read().select("job_id").hint("merge"), "job_id", "left_anti")
        self._put(new.select("job_id", "status", F.lit(None).cast("string").alias("stage"), F.coalesce("progress", F.lit(0)).cast("int").alias("progress"), F.lit(None).cast("string").alias("error"), F.expr("cast(map() as map<string,long>)").alias("totals"), F.lit(0).cast("long").alias("seq")))

    def _controlled(self, asked: DataFrame) -> DataFrame:
        """The active jobs that (job_id, action) pauses or cancels, as they are from then on; cancelled ones whatever else is asked for them."""
        one = asked.where(F.col("action").isin(*CONTROLS)).groupBy("job_id").agg(F.min("action").alias("action"))  # cancel before pause
        to = F.create_map(*[F.lit(x) for kv in CONTROLS.items() for x in kv])
        return self._active().join(one.hint("merge"), "job_id").withColumn("status", to[F.col("action")]).withColumn("seq", F.col("seq") + 1).drop("action")

    def control(self, asked: DataFrame) -> None:
        """Pauses and cancels the active jobs of (job_id, action)."""
        self._put(self._controlled(asked))

    def resume(self, jobs: DataFrame) -> None:
        """Paused jobs of (job_id) go on from where they are."""
        rows = self.state.read().where("status = 'PAUSED'").join(jobs.select("job_id").distinct().hint("merge"), "job_id", "left_semi")
        self._put(rows.withColumn("status", F.lit("RUNNING")).withColumn("seq", F.col("seq") + 1))

    def _active(self) -> DataFrame:
        return self.state.read().where(F.col("status").isin(*ACTIVE))

    def run(self, controls: Callable[[str], DataFrame] | None = None) -> None:
        """Every active job through the steps that it has not ended yet; controls(stage) is asked before each, and once more before the end."""
        for step in self.steps:
            aside = scratch(self.spark)
            stopped = written(self._controlled(controls(step.stage)), f"{aside}/stopped") if controls else None
            due = self._active().where(F.col("progress") < step.ends)
            if stopped is not None:
                due = due.join(stopped.hint("merge"), "job_id", "left_anti")
            if due.isEmpty():
                if stopped is not None:
                    self._put(stopped)
                continue
            done = written(step.work(due.select("job_id")).select("job_id", F.col("found").cast("long").alias("found"), F.substring("error", 1, 1000).alias("_error")), f"{aside}/done")
            rows = due.join(done.groupBy("job_id").agg(F.sum("found").alias("found"), F.max("_error").alias("_error")).hint("merge"), "job_id", "left")
            failed = F.col("_error").isNotNull()
            found = F.map_from_arrays(F.array(F.lit(step.stage)), F.array(F.coalesce("found", F.lit(0))))
            rows = rows.select(
                "job_id",
                F.when(failed, "FAILED").otherwise("RUNNING").alias("status"),
                F.lit(step.stage).alias("stage"),
                F.when(failed, F.col("progress")).otherwise(F.lit(step.ends)).cast("int").alias("progress"),
                F.col("_error").alias("error"),
                F.when(failed, F.col("totals")).otherwise(F.map_concat(F.map_filter("totals", lambda k, _: k != step.stage), found)).alias("totals"),
                (F.col("seq") + 1).alias("seq"),
            )
            self._put(rows if stopped is None else rows.unionByName(stopped))
            remove(self.spark, aside)
        last = self._active().where(F.col("progress") >= self.steps[-1].ends).withColumns({"status": F.lit("COMPLETED"), "stage": F.lit("DONE"), "progress": F.lit(100), "seq": F.col("seq") + 1})
        if controls:  # what is paused or cancelled during the last stage does not end
            stopped = self._controlled(controls("DONE"))
            last = last.join(stopped.hint("merge"), "job_id", "left_anti").unionByName(stopped)
        self._put(last)
        self.state.clean()
