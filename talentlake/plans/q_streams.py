"""Registered queries for the R operators (Structured Streaming).

Each query runs its stream over the given table files with ``availableNow`` into
files under the shared checkpoint folder, then returns the resulting table; the
oracle is the SQL of the batch twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from talentlake.operators import merge as M
from talentlake.plans.oracle_views import with_views as W
from talentlake.plans.q_ingest import UPSERT_SQL, _upsert_inputs
from talentlake.plans.q_work import LIFECYCLE_SQL
from talentlake.plans.registry import ORACLES, register
from talentlake.session import path_exists, scratch_path
from talentlake.sources.tables import Tables
from talentlake.streaming import jobs as JB
from talentlake.streaming import streams as S


def _status_stream(spark, d):
    return _status_events(S.table_stream(spark, d, "events"))


def _status_events(e):
    et = F.col("event_type")
    return e.select(
        "event_id", "user_id", (F.col("user_id") * 1000 + F.dayofmonth("ts")).alias("job_id"),
        F.when(et == "signup", "pending").when(et == "view", "processing").when(et == "purchase", "completed")
        .when(et == "error", "failed").otherwise("cancelled").alias("status"), "ts", "value")


@register("stream_dedupe", "SELECT DISTINCT * FROM (SELECT * FROM events UNION ALL SELECT * FROM events)")
def q_stream_dedupe(spark, d):
    s = S.table_stream(spark, d, "events").unionByName(S.table_stream(spark, d, "events"))
    out = S.write_append(S.dedupe_stream(s, "event_id"), "dedupe")
    return spark.read.parquet(out)


@register("stream_dedupe_late", """
WITH b AS (SELECT *, event_id % 4 AS batch FROM events),
  w AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b GROUP BY batch)
SELECT event_id, ts, user_id, event_type, value, props, coalesce(ts < top - INTERVAL 10 MINUTE, false) AS late
FROM b JOIN w USING (batch)""")
def q_stream_dedupe_late(spark, d):
    """Four micro-batches (event_id modulo 4), each with a copy of the one before, sent as of a day earlier."""
    e, src = Tables(spark, d).events, scratch_path(spark, "late-in")
    for i in range(4):
        again = e.where(F.col("event_id") % 4 == i - 1).withColumn("ts", F.timestamp_add("DAY", F.lit(-1), "ts"))
        part = e.where(F.col("event_id") % 4 == i).unionByName(again)
        part.coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    path = S.dedupe_with_late(s, "event_id", scratch_path(spark, "late-out"))
    main, late = (spark.read.parquet(f"{path}/{n}").select(*e.columns) for n in ("main", "late"))
    return main.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))


@register("stream_tumbling", """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end,
  event_type, count(*) AS invocations, round(sum(value), 4) AS sum_value, round(avg(value), 4) AS avg_value, max(value) AS max_value,
  min(value) AS min_value
FROM events GROUP BY 1, 2, 3""")
def q_stream_tumbling(spark, d):
    s = S.table_stream(spark, d, "events")
    agg = S.metric_windows(s, "event_type", "value")
    log = S.write_changelog(agg, "tumbling", ["window_start", "window_end", "event_type"])
    return S.compact_changelog(spark, log, ["window_start", "window_end", "event_type"], agg.schema)


@register("stream_lifecycle", LIFECYCLE_SQL)
def q_stream_lifecycle(spark, d):
    s = _status_stream(spark, d).withColumn(
        "error", F.when(F.col("status") == "failed", F.concat(F.lit("failed with value "), F.col("value").cast("string"))))
    return JB.lifecycle_stream(s).table()


@register("stream_upsert", UPSERT_SQL)
def q_stream_upsert(spark, d):
    t = Tables(spark, d)
    target, _ = _upsert_inputs(t)
    pt = S.table_stream(spark, d, "part")
    # same projection as the batch twin, applied to the part stream
    up = pt.select(
        (F.col("p_partkey") + 100000).alias("id"),
        F.when(F.col("p_partkey") % 2 == 0, "INDEED").otherwise("GLASSDOOR").alias("source"),
        F.when(F.col("p_size") != 1, F.concat(F.lit("jk"), F.expr("p_partkey * 9 div 10").cast("string"))).alias("source_job_id"),
        F.concat(F.lit("https://new.example/"), F.col("p_partkey").cast("string")).alias("source_url"),
        F.concat(F.col("p_brand"), F.lit(" Inc")).alias("company_name"),
        F.col("p_name").alias("role_title"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_type")).otherwise(F.lit("")).alias("location"),
        F.lit("remote").alias("remote_policy"),
        (F.col("p_size") * 1000).alias("salary_min"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 1500).otherwise(F.lit(0)).alias("salary_max"),
        F.concat_ws(" at ", "p_name", "p_brand").alias("description_text"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).otherwise(F.lit("")).alias("requirements_text"),
        F.col("p_partkey").alias("arrival"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    path = scratch_path(spark, "upsert-snapshots")
    keys = ["source", "source_job_id"]
    S.upsert_stream(M.normalise_posting(up), target, path, keys, M.UPSERT_SET_COLS, "arrival", now)
    return S.read_upsert_table(spark, path, target, keys, M.UPSERT_SET_COLS, "arrival")


MESSAGES_SQL = """
SELECT event_id AS message_id,
  CASE event_type WHEN 'error' THEN '{broken' WHEN 'click' THEN CAST(user_id AS VARCHAR) WHEN 'view' THEN '  '
    ELSE '{"job_id": "' || CAST(user_id AS VARCHAR) || '"}' END AS body,
  CAST(floor(value) AS INT) % 5 + 1 AS receives
FROM events"""


def _messages(s):
    et = F.col("event_type")
    return s.select(
        F.col("event_id").alias("message_id"),
        F.when(et == "error", F.lit("{broken")).when(et == "click", F.col("user_id").cast("string"))
        .when(et == "view", F.lit("  "))
        .otherwise(F.concat(F.lit('{"job_id": "'), F.col("user_id").cast("string"), F.lit('"}'))).alias("body"),
        (F.floor("value").cast("int") % 5 + 1).alias("receives"))


@register("stream_dlq", W([], r"""
SELECT message_id, body, receives, job_id, reason, CASE WHEN reason IS NULL THEN 'jobs' ELSE 'dlq' END AS route FROM (
  SELECT *, CASE WHEN receives > 3 THEN 'max receives exceeded' WHEN job_id IS NULL THEN 'unparsable body' END AS reason FROM (
    SELECT *, coalesce(
      CASE WHEN starts_with(trim(body), '{') AND json_valid(trim(body)) THEN json_extract_string(trim(body), '$.job_id') END,
      CASE WHEN regexp_matches(trim(body), '^[A-Za-z0-9_-]+$') THEN trim(body) END) AS job_id FROM m))""",
    extra=[("m", MESSAGES_SQL)]))
def q_stream_dlq(spark, d):
    s = _messages(S.table_stream(spark, d, "events"))
    jobs, dlq = scratch_path(spark, "jobs-out"), scratch_path(spark, "dlq-out")
    S.dead_letters(s, jobs, dlq)
    parts = []
    for p in (jobs, dlq):
        if path_exists(spark, p):  # a branch that received no rows has no files
            parts.append(spark.read.parquet(p).drop("_batch"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


LOGS_SQL = """
SELECT event_id, event_type AS agent, ts,
  CASE event_type WHEN 'error' THEN 'ERROR failed call ' || CAST(event_id AS VARCHAR)
    WHEN 'view' THEN 'Observability span ' || CAST(event_id AS VARCHAR)
    WHEN 'purchase' THEN 'Exception in handler ' || CAST(event_id AS VARCHAR)
    ELSE 'ok ' || CAST(event_id AS VARCHAR) END AS message
FROM events"""


def _logs(df):
    et = F.col("event_type")
    eid = F.col("event_id").cast("string")
    return df.select("event_id", et.alias("agent"), "ts",
                     F.when(et == "error", F.concat(F.lit("ERROR failed call "), eid))
                     .when(et == "view", F.concat(F.lit("Observability span "), eid))
                     .when(et == "purchase", F.concat(F.lit("Exception in handler "), eid))
                     .otherwise(F.concat(F.lit("ok "), eid)).alias("message"))


@register("log_levels", W([], """
SELECT *, CASE WHEN message LIKE '%ERROR%' OR message LIKE '%Exception%' THEN 'ERROR'
               WHEN message LIKE '%LangFuse%' OR message LIKE '%Observability%' THEN 'TRACE' ELSE 'INFO' END AS level
FROM lg""", extra=[("lg", LOGS_SQL)]))
def q_log_levels(spark, d):
    base = S.table_stream(spark, d, "events")
    sources = [_logs(base.where(F.col("event_id") % 2 == i)) for i in (0, 1)]
    return spark.read.parquet(S.write_append(S.merged_log(sources), "logs"))


@register("recent_lines", W([], """
SELECT event_id, agent, ts, message FROM lg WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY""", extra=[("lg", LOGS_SQL)]))
def q_recent_lines(spark, d):
    e = Tables(spark, d).events
    return S.recent_lines(_logs(e), e.agg(F.max("ts")).scalar(), 5 * 24 * 60)


@register("late_events", W([], """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, agent, count(*) AS late_lines FROM (
  SELECT *, max(ts) OVER (ORDER BY 2 * event_id + CASE WHEN event_id % 7 = 0 THEN 81 ELSE 0 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM lg)
WHERE ts < wm - INTERVAL 5 MINUTE GROUP BY 1, 2""", extra=[("lg", LOGS_SQL)]))
def q_late_events(spark, d):
    """Every seventh line arrives forty lines late."""
    late = F.when(F.col("event_id") % 7 == 0, 81).otherwise(0)
    logs = _logs(Tables(spark, d).events).withColumn("arrival", 2 * F.col("event_id") + late)
    return S.late_events(logs, "arrival")


@register("late_events_stream", ORACLES["late_events"])
def q_late_events_stream(spark, d):
    """The same lines in four micro-batches by arrival, each in no order."""
    late = F.when(F.col("event_id") % 7 == 0, 81).otherwise(0)
    logs = _logs(Tables(spark, d).events).withColumn("arrival", 2 * F.col("event_id") + late)
    src, end = scratch_path(spark, "logs-in"), logs.agg(F.max("arrival")).scalar()
    part = F.floor(F.col("arrival") * 4 / (end + 1))
    for i in range(4):
        logs.where(part == i).orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    return S.late_stream(s, "arrival").late_report()


@register("stream_pending", W([], """
SELECT job_id // 1000 AS user_id, count(*) AS jobs, CAST(count_if(state = 'pending') AS BIGINT) AS pending,
  CAST(count_if(state = 'processing') AS BIGINT) AS processing, CAST(count_if(state = 'completed') AS BIGINT) AS completed,
  CAST(count_if(state = 'failed') AS BIGINT) AS failed, CAST(count_if(state = 'cancelled') AS BIGINT) AS cancelled
FROM life GROUP BY 1""", extra=[("life", LIFECYCLE_SQL)]))
def q_stream_pending(spark, d):
    """Jobs by the state they are in, out of three micro-batches (event_id modulo 3): jobs change state in every one."""
    e, src = Tables(spark, d).events, scratch_path(spark, "kpis-in")
    for i in range(3):
        e.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    return JB.live_kpis(_status_events(s)).table()
