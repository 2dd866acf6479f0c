"""R3, R7, R1 and R6 as tables kept by micro-batches: any split of the events, replays, timers, retention."""

import datetime as dt
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talentlake.operators import work as WK
from talentlake.session import scratch_path
from talentlake.streaming import jobs as JB
from talentlake.streaming import streams as S
from talentlake.streaming import tables as TB

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_id BIGINT, job_id BIGINT, event_id BIGINT, status STRING, ts TIMESTAMP_NTZ, error STRING"


def minute(k):
    return T0 + dt.timedelta(minutes=k)


def events(seed, jobs=50):
    rng = random.Random(seed)
    out = []
    for job in range(jobs):
        for _ in range(rng.randint(1, 8)):
            s = rng.choice(["pending", "processing", "completed", "failed", "processing", "completed", "completed"] + ["cancelled"] * (job % 5 == 0))
            i = len(out) + 1
            out.append((job // 7, job, i, s, minute(rng.randint(0, 40)), f"err {i}" if s == "failed" else None))
    return out


def batches(rows, seed, n=4):
    rng, parts = random.Random(seed), [[] for _ in range(n)]
    for r in rows:
        rng.choice(parts).append(r)
    return parts


def tuples(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1])
def test_lifecycle_equals_the_fold_over_any_split_and_replay(spark, seed):
    rows = events(seed)
    want = WK.job_lifecycle(spark.createDataFrame(rows, SCHEMA), error="error")
    frames = [spark.createDataFrame(p, SCHEMA) for p in batches(rows, seed)]
    kept = JB.LifecycleTable(spark, scratch_path(spark, "t-life"), frames[0].schema, compact_every=2, buckets=3)
    for i, f in enumerate(frames):
        kept.sink(f, i)
        if i in (1, 2):  # once where the batch made a base, once where it did not
            kept.sink(f, i)
    assert tuples(kept.table(), *want.columns) == tuples(want)
    assert sorted(TB.bases(spark, kept.summaries.path)) == [1, 3]
    assert sorted(TB.folders(spark, f"{kept.summaries.path}/log", "_batch")) == [2, 3]
    assert "Python" not in kept.table()._jdf.queryExecution().executedPlan().toString()


def test_lifecycle_stream_runs_in_batches(spark, tmp_path):
    rows, src = events(3), str(tmp_path / "ev")
    for part in batches(rows, 3, 3):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    kept = JB.lifecycle_stream(s)
    want = WK.job_lifecycle(spark.createDataFrame(rows, SCHEMA), error="error")
    assert tuples(kept.table(), *want.columns) == tuples(want)
    assert sorted(TB.finished(spark, f"{kept.summaries.path}/log", "_batch")) == [0, 1, 2]


def test_completed_events_that_may_still_decide_are_kept(spark):
    """A late processing event makes the completed event before it void and the one after it count."""
    one = lambda i, s, m: spark.createDataFrame([(0, 9, i, s, minute(m), None)], SCHEMA)
    kept = JB.LifecycleTable(spark, scratch_path(spark, "t-life"), one(1, "a", 0).schema, compact_every=1)
    for i, (status, at) in enumerate([("processing", 0), ("completed", 3), ("completed", 8), ("processing", 5), ("completed", 6), ("completed", 1)]):
        kept.sink(one(i, status, at), i)
    r = kept.table().first()
    assert (r.state, r.started_at, r.completed_at, r.last_event_at, r.events) == ("completed", minute(0), minute(6), minute(8), 6)
    assert sorted(x.done.ts for x in kept.completions.table().collect()) == [minute(6), minute(8)]


def test_timers_report_a_silence_once_and_keep_the_state(spark):
    def batch(*rows):
        return spark.createDataFrame([(0, j, i, s, t, None) for j, i, s, t in rows], SCHEMA)

    first = batch((1, 1, "processing", minute(0)), (2, 2, "pending", minute(0)), (3, 3, "completed", minute(0)), (4, 4, "cancelled", minute(0)),
                  (5, 5, "processing", minute(55)))
    kept = JB.LifecycleTable(spark, scratch_path(spark, "t-life"), first.schema, stuck_after_seconds=600)
    kept.sink(first, 0)
    stuck = lambda m: sorted((r.job_id, r.state, r.last_event_at) for r in kept.fire_timers(minute(m)).collect())
    assert stuck(5) == []
    kept.sink(batch((2, 6, "processing", minute(8))), 1)
    assert stuck(11) == [(1, "processing", minute(0))]
    assert stuck(18) == [(2, "processing", minute(8))]
    assert stuck(19) == []
    kept.sink(batch((1, 7, "completed", minute(30)), (2, 8, "pending", minute(31))), 2)
    assert stuck(70) == [(2, "pending", minute(31)), (5, "processing", minute(55))]
    assert {r.job_id: (r.state, r.events) for r in kept.table().collect()} == {
        1: ("completed", 2), 2: ("pending", 3), 3: ("pending", 1), 4: ("cancelled", 1), 5: ("processing", 1)}
    assert stuck(60 * 24 * 3) == [] and TB.folders(spark, f"{kept.path}/timers", "_due") == {}


def test_retention_forgets_finished_jobs_only(spark):
    rows = [(0, 1, 1, "processing", minute(0), None), (0, 1, 2, "completed", minute(1), None), (0, 2, 3, "pending", minute(0), None),
            (0, 3, 4, "failed", minute(100), "x" * 900)]
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = JB.LifecycleTable(spark, scratch_path(spark, "t-life"), frame.schema, retain_seconds=3600, compact_every=1)
    kept.sink(frame, 0)
    assert {r.job_id: r.state for r in kept.table().collect()} == {2: "pending", 3: "failed"}
    assert [len(r.error_message) for r in kept.table().where("job_id = 3").collect()] == [500]


@pytest.mark.parametrize("seed", [4])
def test_kpis_count_jobs_by_the_state_they_are_in(spark, seed):
    rows = events(seed)
    frames = [spark.createDataFrame(p, SCHEMA) for p in batches(rows, seed)]
    kept = JB.KpiTable(spark, scratch_path(spark, "t-kpi"), frames[0].schema, compact_every=2, buckets=3)
    for i, f in enumerate(frames):
        kept.sink(f, i)
        kept.sink(f, i)  # every batch is replayed
        so_far = spark.createDataFrame([r for p in batches(rows, seed)[:i + 1] for r in p], SCHEMA)
        state = {r.job_id: r.state for r in WK.job_lifecycle(so_far, error="error").collect()}
        want = {u: Counter(state[j] for j in state if j // 7 == u) for u in {j // 7 for j in state}}
        got = {r.user_id: r for r in kept.table().collect()}
        assert {u: (sum(c.values()), *[c[s] for s in JB.JOB_STATES]) for u, c in want.items()} == {
            u: (r.jobs, *[r[s] for s in JB.JOB_STATES]) for u, r in got.items()}
    assert "Python" not in kept.table()._jdf.queryExecution().executedPlan().toString()


def test_kpis_follow_a_job_to_another_user(spark):
    one = lambda u, i, s: spark.createDataFrame([(u, 9, i, s, minute(i), None)], SCHEMA)
    kept = JB.KpiTable(spark, scratch_path(spark, "t-kpi"), one(1, 1, "a").schema)
    kept.sink(one(1, 1, "pending"), 0)
    kept.sink(one(2, 2, "processing"), 1)
    kept.sink(one(1, 0, "pending"), 2)  # older than what is known
    assert tuples(kept.table(), "user_id", "jobs", "pending", "processing") == [(1, 0, 0, 0), (2, 1, 0, 1)]


def test_dedupe_knows_an_id_that_comes_again_on_another_day(spark, tmp_path):
    src = str(tmp_path / "in")
    for rows in ([(1, minute(0)), (2, minute(60))], [(1, minute(60 * 24 + 5)), (3, minute(60 * 24)), (None, minute(60 * 24))],
                 [(2, minute(60)), (3, minute(60 * 48)), (None, minute(60 * 24)), (4, minute(30))]):
        spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP_NTZ").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    s = spark.readStream.schema("event_id BIGINT, ts TIMESTAMP_NTZ").option("maxFilesPerTrigger", 1).parquet(src)
    before = spark.conf.get(S.STATE_STORE)
    path = S.dedupe_with_late(s, "event_id", scratch_path(spark, "t-days"))
    assert spark.conf.get(S.STATE_STORE) == before
    got = {n: sorted((str(r.event_id), r.ts) for r in spark.read.parquet(f"{path}/{n}").collect()) for n in ("main", "late")}
    assert got["main"] == [("1", minute(0)), ("2", minute(60)), ("3", minute(1440)), ("None", minute(1440)), ("None", minute(1440))]
    assert got["late"] == [("4", minute(30))]


@pytest.mark.parametrize("chunk", [3])
def test_late_stream_equals_the_batch_report(spark, tmp_path, chunk):
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), minute(i // 3 - (rng.random() < 0.3) * rng.randint(0, 25)), f"line {i}") for i in range(120)]
    schema, src = "arrival INT, agent STRING, ts TIMESTAMP_NTZ, message STRING", str(tmp_path / "logs")
    for at in range(0, 120, 30):
        part = rows[at:at + 30]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    kept = S.late_stream(s, "arrival", chunk=chunk)
    want = S.late_events(spark.createDataFrame(rows, schema), "arrival", chunk=chunk)
    assert tuples(kept.late_report(), *want.columns) == tuples(want) and want.count() > 3
    late = tuples(kept.lines(late=True))
    assert sorted(late + tuples(kept.lines(late=False)), key=repr) == sorted(rows, key=repr)
    assert len(late) == want.agg(F.sum("late_lines")).first()[0]


def test_upsert_stream_deletes_what_bases_replace(spark, tmp_path):
    schema = "id INT, source STRING, source_job_id STRING, company_name STRING, arrival INT"
    target = spark.createDataFrame([], "id INT, source STRING, source_job_id STRING, company_name STRING, updated_at TIMESTAMP_NTZ, is_active BOOLEAN")
    src, path = str(tmp_path / "src"), scratch_path(spark, "t-upsert")
    for i in range(7):
        spark.createDataFrame([(i, "s", str(i % 3), f"c{i}", i)], schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    S.upsert_stream(s, target, path, ["source", "source_job_id"], ["company_name"], "arrival", F.lit("2024-02-01").cast("timestamp_ntz"), compact_every=2)
    got = S.read_upsert_table(spark, path, target, ["source", "source_job_id"], ["company_name"], "arrival")
    assert {r.source_job_id: r.company_name for r in got.collect()} == {"0": "c6", "1": "c4", "2": "c5"}
    assert sorted(TB.bases(spark, path)) == [3, 5] and sorted(TB.folders(spark, f"{path}/deltas", "_batch")) == [4, 5, 6]
