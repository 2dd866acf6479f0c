"""R3 and R7: states of jobs, and counters of them, kept by micro-batches.

A job's events are reduced to a summary that combines associatively: first cancelled event, last event, last
event other than completed, first processing event, last failure and a count.  Any split of the events into
batches, in any order, gives the summary of all of them, and with it the fold over the events in order of
(time, id).  All of it is native aggregation; a batch's cost follows its own jobs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talentlake.operators.work import ERROR_MAX_CHARS, QUEUE_VISIBILITY_SECONDS
from talentlake.session import path_exists, scratch_path
from talentlake.streaming.tables import BatchLog, delete_before

# The states of a job.
JOB_STATES = ["pending", "processing", "completed", "failed", "cancelled"]
OPEN_STATES = ["pending", "processing"]


def _summaries(events: DataFrame, job: str, status: str, ts: str, key: str, error: str | None, carry: Sequence[str]) -> DataFrame:
    """Every event as the summary of its job so far."""
    at, s = F.struct(F.col(ts).alias("ts"), F.col(key).alias("key")), F.col(status)
    err = F.col(error) if error else F.lit(None).cast("string")
    with_status = F.struct(F.col(ts).alias("ts"), F.col(key).alias("key"), s.alias("status"))
    return events.select(
        F.col(job).alias("job_id"),
        F.when(s == "cancelled", at).alias("first_cancel"),
        F.struct(F.col(ts).alias("ts"), F.col(key).alias("key"), s.alias("status"), *[F.col(c).alias(c) for c in carry]).alias("last"),
        F.when(s != "completed", with_status).alias("other"),
        F.when(s == "processing", at).alias("first_processing"),
        F.when(s == "failed", F.struct(F.col(ts).alias("ts"), F.col(key).alias("key"), err.alias("error"))).alias("failure"),
        F.lit(1).cast("long").alias("events"))


def combine(summaries: DataFrame) -> DataFrame:
    """One summary per job (partial aggregation: a job with most of the events sends a row per task)."""
    return summaries.groupBy("job_id").agg(
        F.min("first_cancel").alias("first_cancel"), F.max("last").alias("last"), F.max("other").alias("other"),
        F.min("first_processing").alias("first_processing"), F.max("failure").alias("failure"), F.sum("events").alias("events"))


def state() -> Column:
    """A summary's state: cancelled is final, completed counts after processing only."""
    return (F.when(F.col("first_cancel").isNotNull(), F.lit("cancelled"))
            .when(F.col("last.status") != "completed", F.col("last.status"))
            .when(F.col("other.status") == "processing", F.lit("completed"))
            .otherwise(F.coalesce("other.status", F.lit("pending"))))


def _after(a: str, b: str) -> Column:
    return F.struct(F.col(f"{a}.ts"), F.col(f"{a}.key")) > F.struct(F.col(f"{b}.ts"), F.col(f"{b}.key"))


# --------------------------------------------------------------------------- R3
class LifecycleTable:
    """The lifecycle (W1) of all jobs of a stream of events, kept under ``path``.

    ``summaries`` holds a summary per job and ``completions`` the completed events that may still decide when a
    job was completed: those after its last other event.  ``timers`` holds, by the day on which they are due,
    the times at which jobs that were left pending or processing count as stuck.
    """

    def __init__(self, spark: SparkSession, path: str, events: StructType, job: str = "job_id", status: str = "status",
                 ts: str = "ts", key: str = "event_id", error: str | None = "error",
                 stuck_after_seconds: int = QUEUE_VISIBILITY_SECONDS, retain_seconds: int | None = None,
                 compact_every: int = 16, buckets: int = 16):
        self.spark, self.path, self.columns = spark, path, (job, status, ts, key, error)
        self.stuck_after, self.retain = stuck_after_seconds, retain_seconds
        one = self._one(spark.createDataFrame([], events))
        done = self._completed(spark.createDataFrame([], events))
        self.summaries = BatchLog(spark, f"{path}/summaries", combine(one).schema, combine, "job_id", buckets, compact_every,
                                  self._kept)
        self.completions = BatchLog(spark, f"{path}/completions", done.schema, self._undecided, "job_id", buckets, compact_every)

    def _one(self, events: DataFrame) -> DataFrame:
        job, status, ts, key, error = self.columns
        return _summaries(events, job, status, ts, key, error, ())

    def _completed(self, events: DataFrame) -> DataFrame:
        job, status, ts, key, _ = self.columns
        return events.where(F.col(status) == "completed").select(
            F.col(job).alias("job_id"), F.struct(F.col(ts).alias("ts"), F.col(key).alias("key")).alias("done"))

    def _undecided(self, rows: DataFrame) -> DataFrame:
        now = self.summaries.table().select("job_id", "other", F.col("first_cancel").isNotNull().alias("_final"))
        near = rows.distinct().join(now, "job_id").where(~F.col("_final"))
        return near.where(F.col("other").isNull() | _after("done", "other")).select("job_id", "done")

    def _kept(self, table: DataFrame) -> DataFrame:
        if self.retain is None:
            return table
        newest = table.agg(F.max("last.ts")).scalar()
        gone = ~state().isin(OPEN_STATES) & (F.col("last.ts") < F.timestamp_add("SECOND", F.lit(-self.retain), newest))
        return table.where(~F.coalesce(gone, F.lit(False)))

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        one = combine(self._one(batch)).persist()
        try:
            self.summaries.write(one, batch_id)
            self.completions.write(self._completed(batch), batch_id)
            due = F.timestamp_add("SECOND", F.lit(self.stuck_after), F.col("last.ts"))
            timers = one.where(F.col("last.status").isin(OPEN_STATES) & F.col("first_cancel").isNull()).select("job_id", due.alias("due"))
            # files follow the days, not tasks x days
            (timers.withColumns({"_due": F.date_format("due", "yyyyMMdd").cast("long"), "_batch": F.lit(batch_id).cast("long")})
             .hint("rebalance", "_due").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_due", "_batch").parquet(f"{self.path}/timers"))
        finally:
            one.unpersist()
        self.summaries.compact(batch_id)
        self.completions.compact(batch_id)

    def table(self, only: DataFrame | None = None) -> DataFrame:
        """job_id, state, started_at, completed_at, last_event_at, error_message, events."""
        now = self.summaries.table(only=only).withColumn("state", state())
        open_ended = now.where(F.col("state") == "completed").select("job_id", "other")
        done = (self.completions.rows(only=only).join(open_ended, "job_id").where(_after("done", "other"))
                .groupBy("job_id").agg(F.min("done").alias("done")))
        started = F.when(F.col("first_cancel").isNull() | (F.col("first_processing") < F.col("first_cancel")), F.col("first_processing.ts"))
        completed = (F.when(F.col("state") == "cancelled", F.col("first_cancel.ts")).when(F.col("state") == "failed", F.col("other.ts"))
                     .when(F.col("state") == "completed", F.col("done.ts")))
        error = F.when(F.col("state") == "failed", F.left(F.col("failure.error"), F.lit(ERROR_MAX_CHARS)))
        return now.join(done, "job_id", "left").select(
            F.col("job_id").alias(self.columns[0]), "state", started.alias("started_at"), completed.alias("completed_at"),
            F.col("last.ts").alias("last_event_at"), error.alias("error_message"), "events")

    def fire_timers(self, now: dt.datetime) -> DataFrame:
        """Jobs that are stuck at ``now`` and were not reported for this silence before (their state stays).

        Reads the timers that are due, not the table of jobs; days that are over are deleted."""
        job = self.columns[0]
        schema = f"{job} {self.summaries.schema['job_id'].dataType.simpleString()}, last_event_at TIMESTAMP_NTZ, state STRING"
        out, day = f"{self.path}/stuck/_fired={int(now.timestamp())}", int(now.strftime("%Y%m%d"))
        if path_exists(self.spark, f"{self.path}/timers"):
            timers = self.spark.read.parquet(f"{self.path}/timers").where((F.col("_due") <= day) & (F.col("due") <= F.lit(now).cast("timestamp_ntz")))
            # a silence of which the end is known: events that came later have their own timers
            late = timers.select("job_id", F.timestamp_add("SECOND", F.lit(-self.stuck_after), F.col("due")).alias("last_event_at")).distinct()
            current = self.table(only=late.select("job_id").distinct()).where(F.col("state").isin(OPEN_STATES))
            stuck = current.join(late.withColumnRenamed("job_id", job), [job, "last_event_at"]).select(job, "last_event_at", "state")
            if path_exists(self.spark, f"{self.path}/stuck"):
                told = self.spark.read.schema(f"{schema}, _fired LONG").parquet(f"{self.path}/stuck").where(F.col("_fired") < int(now.timestamp()))
                stuck = stuck.join(told, [job, "last_event_at"], "left_anti")
            stuck.write.mode("overwrite").parquet(out)
            delete_before(self.spark, f"{self.path}/timers", "_due", day)
        return self.spark.read.schema(schema).parquet(out) if path_exists(self.spark, out) else self.spark.createDataFrame([], schema)


def lifecycle_stream(s: DataFrame, path: str | None = None, checkpoint: str | None = None, **options) -> LifecycleTable:
    """Run a stream of job events (job_id, event_id, status, ts, error) into a ``LifecycleTable``."""
    from talentlake.streaming.streams import run_available

    spark = s.sparkSession
    kept = LifecycleTable(spark, path or scratch_path(spark, "lifecycle"), s.schema, **options)
    run_available(s.writeStream.option("checkpointLocation", checkpoint or scratch_path(spark, "lifecycle-ckpt")).foreachBatch(kept.sink))
    return kept


# --------------------------------------------------------------------------- R7
class KpiTable:
    """Per user the number of jobs that are now in each state, kept under ``path`` by signed differences.

    A batch looks up the states that its jobs had before it (the folders its keys are in), and a job whose state
    or user changed counts -1 where it was and +1 where it is.  Differences add up in any order; a replayed batch
    looks up the same state (of the batches before it) and overwrites its own differences.
    """

    def __init__(self, spark: SparkSession, path: str, events: StructType, user: str = "user_id", job: str = "job_id",
                 status: str = "status", ts: str = "ts", key: str = "event_id", compact_every: int = 16, buckets: int = 16):
        self.user, self.columns = user, (job, status, ts, key, None, (user,))
        one = combine(self._one(spark.createDataFrame([], events)))
        self.jobs = BatchLog(spark, f"{path}/jobs", one.schema, combine, "job_id", buckets, compact_every)
        counts = self._differences(one, one)
        self.counts = BatchLog(spark, f"{path}/counts", counts.schema, self._added, None, 1, compact_every)

    def _one(self, events: DataFrame) -> DataFrame:
        return _summaries(events, *self.columns)

    def _added(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.user).agg(*[F.sum(c).alias(c) for c in ("jobs", *JOB_STATES)])

    def _differences(self, before: DataFrame, after: DataFrame) -> DataFrame:
        def stood(df: DataFrame, name: str) -> DataFrame:
            return df.select("job_id", F.struct(F.col(f"last.{self.user}").alias("user"), state().alias("state")).alias(name))

        both = stood(after, "now").join(stood(before, "was"), "job_id", "left").where(~F.col("now").eqNullSafe(F.col("was")))
        signed = F.array(F.struct(F.col("now.user").alias("user"), F.col("now.state").alias("state"), F.lit(1).alias("sign")),
                         F.when(F.col("was").isNotNull(), F.struct(F.col("was.user").alias("user"), F.col("was.state").alias("state"), F.lit(-1).alias("sign"))))
        rows = both.select(F.explode(signed).alias("d")).where("d IS NOT NULL")
        return rows.groupBy(F.col("d.user").alias(self.user)).agg(
            F.sum("d.sign").alias("jobs"), *[F.sum(F.when(F.col("d.state") == s, F.col("d.sign")).otherwise(0)).alias(s) for s in JOB_STATES])

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        new = combine(self._one(batch)).persist()
        try:
            before = self.jobs.table(before=batch_id, only=new.select("job_id"))
            self.counts.write(self._differences(before, combine(before.unionByName(new))), batch_id)
            self.jobs.write(new, batch_id)
        finally:
            new.unpersist()
        self.jobs.compact(batch_id)
        self.counts.compact(batch_id)

    def table(self) -> DataFrame:
        """user, jobs, and how many of them are pending, processing, completed, failed, cancelled."""
        return self.counts.table()


def live_kpis(s: DataFrame, path: str | None = None, checkpoint: str | None = None, **options) -> KpiTable:
    """Run a stream of job events (user_id, job_id, event_id, status, ts) into a ``KpiTable``."""
    from talentlake.streaming.streams import run_available

    spark = s.sparkSession
    kept = KpiTable(spark, path or scratch_path(spark, "kpis"), s.schema, **options)
    run_available(s.writeStream.option("checkpointLocation", checkpoint or scratch_path(spark, "kpis-ckpt")).foreachBatch(kept.sink))
    return kept
