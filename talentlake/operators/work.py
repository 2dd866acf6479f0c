"""W: work-item (job / agent) analytics in batch.

The lifecycle fold is written in closed form with ordinary aggregates
(``min``/``max_by`` over ``struct(ts, id)``), so it needs neither a per-job sort
nor collected event arrays: a job with millions of redelivered events is
reduced map-side like any other key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.plans.views import APPLICATION_STATUSES

# Job states and the longest stored error text.
TERMINAL = ["completed", "failed", "cancelled"]
ERROR_MAX_CHARS = 500
QUEUE_VISIBILITY_SECONDS = 910
TEST_JOB_LIMIT_SECONDS = 180


def _order(ts: str, key: str) -> Column:
    return F.struct(F.col(ts), F.col(key))


# --------------------------------------------------------------------------- W1
def job_lifecycle(events: DataFrame, job: str = "job_id", status: str = "status", ts: str = "ts",
                  key: str = "event_id", error: str | None = None) -> DataFrame:
    """Final state of every job from its status events (fold in closed form).

    Fold: processing always applies; completed only from processing; failed and pending
    apply unless cancelled; cancelled is final.  Closed form: keep events up to the first
    cancelled; if the last kept one is not completed it is the state; else completed when
    the last other event is processing, otherwise that event (pending when none).
    started_at = first processing; completed_at = time the final terminal state was reached
    (for failed: the last non-completed event, which set the state — later completed events are ignored).
    """
    o = _order(ts, key)
    s = F.col(status)
    err = F.col(error) if error else F.lit(None).cast("string")
    # one aggregate per job (partial map-side): a cancel makes the job cancelled whatever follows,
    # otherwise the closed form over all events applies
    agg = events.groupBy(F.col(job).alias(job)).agg(
        F.min(F.when(s == "cancelled", o)).alias("_cancel"),
        F.max_by(s, o).alias("_last"),
        F.max(o).alias("_last_o"),
        F.max_by(s, F.when(s != "completed", o)).alias("_other"),
        F.max(F.when(s != "completed", o)).alias("_other_o"),
        F.min(F.when(s == "processing", o)).alias("_proc"),
        F.max_by(err, F.when(s == "failed", o)).alias("_err"),
        F.count(F.lit(1)).alias("events"),
    )
    state = (
        F.when(F.col("_cancel").isNotNull(), F.lit("cancelled"))
        .when(F.col("_last") != "completed", F.col("_last"))
        .when(F.col("_other") == "processing", F.lit("completed"))
        .otherwise(F.coalesce(F.col("_other"), F.lit("pending")))
    )
    base = agg.withColumn("state", state)
    # completed-from-processing: the transition time is the first completed event after that
    # processing event — a second pass over the completed events only, keyed by job
    done = events.where(s == "completed").select(F.col(job).alias("_j"), o.alias("_o"), F.col(ts).alias("_t"))
    firstc = (
        done.join(base.where(F.col("state") == "completed").select(F.col(job).alias("_j"), "_other_o"), "_j")
        .where(F.col("_o") > F.col("_other_o"))
        .groupBy(F.col("_j").alias(job)).agg(F.min("_t").alias("_done_at"))
    )
    out = base.join(firstc, job, "left")
    started = F.when(F.col("_proc").isNotNull() & (F.col("_cancel").isNull() | (F.col("_proc") < F.col("_cancel"))),
                     F.col("_proc")[ts])
    completed_at = (
        F.when(F.col("state") == "cancelled", F.col("_cancel")[ts])
        .when(F.col("state") == "failed", F.col("_other_o")[ts])
        .when(F.col("state") == "completed", F.col("_done_at"))
    )
    return out.select(
        job, "state", started.alias("started_at"), completed_at.alias("completed_at"),
        F.col("_last_o")[ts].alias("last_event_at"),
        F.when(F.col("state") == "failed", F.left(F.col("_err"), F.lit(ERROR_MAX_CHARS))).alias("error_message"),
        "events",
    )


def fold_lifecycle(statuses: Sequence[str]) -> str:
    """Reference fold over one job's ordered statuses (used by tests as the brute-force twin)."""
    state = "pending"
    for st in statuses:
        if state == "cancelled":
            break
        if st == "completed":
            if state == "processing":
                state = "completed"
        else:
            state = st
    return state


# --------------------------------------------------------------------------- W2
def payload_merge(results: DataFrame, agents: Sequence[str], job: str = "job_id", agent: str = "agent",
                  ts: str = "ts", key: str = "event_id", payload: str = "payload", part: str | None = None,
                  parts: Sequence[str] = ("cv", "job"), error: str = "error") -> DataFrame:
    """One row per job: each agent's latest payload in its own column (later result overwrites
    only that column); the extractor keeps its cv and job parts side by side; the latest error
    is kept next to partial results.  One aggregate with conditional ``max_by`` (no pivot shuffle)."""
    o = _order(ts, key)
    a = F.col(agent)
    cols = []
    for name in agents:
        if part and name == "extractor":
            for p in parts:
                hit = (a == name) & (F.col(part) == p)
                cols.append(F.max_by(F.col(payload), F.when(hit, o)).alias(f"{name}_{p}_payload"))
        else:
            cols.append(F.max_by(F.col(payload), F.when(a == name, o)).alias(f"{name}_payload"))
    cols.append(F.max_by(F.col(error), F.when(F.col(error).isNotNull(), o)).alias("error"))
    cols.append(F.max(F.col(ts)).alias("updated_at"))
    return results.groupBy(job).agg(*cols)


# --------------------------------------------------------------------------- W3
def missing_steps(jobs: DataFrame, done: DataFrame, plan: Mapping[str, Sequence[str]], job: str = "job_id",
                  job_type: str = "job_type", step: str = "step") -> DataFrame:
    """Expected steps of every job (by its type) that have no result yet.

    The plan is a tiny dimension (types × steps), joined by equality on the type; the
    done set is removed with a left anti join on (job, step).
    """
    spark: SparkSession = jobs.sparkSession
    plan_df = spark.createDataFrame([(t, s, i) for t, steps in plan.items() for i, s in enumerate(steps)],
                                    f"{job_type} STRING, {step} STRING, step_order INT")
    expected = jobs.select(job, job_type).join(F.broadcast(plan_df), job_type)
    return expected.join(done.select(job, step), [job, step], "left_anti")


# --------------------------------------------------------------------------- W4
def stuck_jobs(lifecycle: DataFrame, now: Column, limit_seconds: int = QUEUE_VISIBILITY_SECONDS,
               state: str = "state", last: str = "last_event_at") -> DataFrame:
    """Jobs still pending/processing whose last event is older than the limit."""
    age = F.timestamp_diff("SECOND", F.col(last), now)
    return lifecycle.where(F.col(state).isin("pending", "processing") & (age > limit_seconds)).withColumn(
        "age_seconds", age)


# --------------------------------------------------------------------------- W5
def answer_upsert(answers: DataFrame, session: str = "session_id", question: str = "question_id",
                  order: str = "turn", answer: str = "answer") -> DataFrame:
    """Latest answer per (session, question) — a new answer replaces the old one — plus how many
    times it was answered; evaluations always append, so every answer counts as one evaluation."""
    return answers.groupBy(session, question).agg(
        F.max_by(F.col(answer), F.col(order)).alias("answer"),
        F.count(F.lit(1)).alias("attempts"),
        F.max(F.col(order)).alias("answered_at"),
    )


# --------------------------------------------------------------------------- W6
def active_postings(disc: DataFrame, now: Column, active: str = "is_active", expires: str = "expires_at") -> DataFrame:
    """Postings that are active and not past their expiry."""
    return disc.where(F.col(active) & (F.col(expires).isNull() | (F.col(expires) > now)))


def expire_pass(disc: DataFrame, now: Column, active: str = "is_active", expires: str = "expires_at") -> DataFrame:
    """Expiry pass: postings past ``expires_at`` become inactive; all rows are kept."""
    return disc.withColumn(active, F.col(active) & (F.col(expires).isNull() | (F.col(expires) > now)))


# --------------------------------------------------------------------------- W7
def application_state(changes: DataFrame, app: str = "app_id", status: str = "status", ts: str = "ts",
                      order: Sequence[str] = (), notes: str = "notes") -> DataFrame:
    """Fold status changes per application.

    latest status and its time, applied_at = last time the status became 'applied', notes = last
    non-empty note; statuses outside the eleven allowed values are rejected (counted, not applied).
    """
    o = F.struct(F.col(ts), *[F.col(c) for c in order], F.col(status))
    valid = F.col(status).isin(APPLICATION_STATUSES)
    has_note = F.coalesce(F.trim(F.col(notes)), F.lit("")) != ""
    return changes.groupBy(app).agg(
        F.max_by(F.col(status), F.when(valid, o)).alias("status"),
        F.max(F.when(valid, F.col(ts))).alias("last_status_change"),
        F.max(F.when(F.col(status) == "applied", F.col(ts))).alias("applied_at"),
        F.max_by(F.col(notes), F.when(has_note, F.struct(F.col(ts), *[F.col(c) for c in order], F.col(notes)))).alias("notes"),
        F.count_if(~valid).alias("rejected_changes"),
    )


def retained(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """W6 retention: rows younger than ``days`` (logs 7 days, queue messages 1 day)."""
    return df.where(F.col(ts) >= F.timestamp_add("DAY", F.lit(-days), now))
