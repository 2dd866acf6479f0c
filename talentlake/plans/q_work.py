"""Registered queries for the W operators (work items, agents, answers, postings, applications)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentlake.operators import work as WK
from talentlake.plans import views as V
from talentlake.plans.oracle_views import with_views as W
from talentlake.plans.registry import register
from talentlake.sources.tables import Tables

LIFECYCLE_SQL = W(["v_status_events"], """
SELECT job_id, state,
  CASE WHEN p_rn IS NOT NULL AND (c_rn IS NULL OR p_rn < c_rn) THEN p_ts END AS started_at,
  CASE WHEN state = 'cancelled' THEN c_ts WHEN state = 'failed' THEN o_ts
       WHEN state = 'completed' THEN (SELECT min(e2.ts) FROM e e2 WHERE e2.job_id = s.job_id AND e2.status = 'completed'
                                      AND e2.rn > s.o_rn) END AS completed_at,
  l_ts AS last_event_at,
  CASE WHEN state = 'failed' THEN left('failed with value ' || CAST(o_value AS VARCHAR), 500) END AS error_message,
  events
FROM (SELECT *, CASE WHEN c_rn IS NOT NULL THEN 'cancelled' WHEN l_status <> 'completed' THEN l_status
                     WHEN o_status = 'processing' THEN 'completed' ELSE coalesce(o_status, 'pending') END AS state
      FROM (SELECT a.*, el.status AS l_status, el.ts AS l_ts, eo.ts AS o_ts, eo.value AS o_value, eo.status AS o_status,
                   ec.ts AS c_ts, ep.ts AS p_ts
            FROM a JOIN e el ON el.job_id = a.job_id AND el.rn = a.l_rn
            LEFT JOIN e eo ON eo.job_id = a.job_id AND eo.rn = a.o_rn
            LEFT JOIN e ec ON ec.job_id = a.job_id AND ec.rn = a.c_rn
            LEFT JOIN e ep ON ep.job_id = a.job_id AND ep.rn = a.p_rn)) s""", extra=[
    ("e", """SELECT job_id, status, ts, event_id, value,
             row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM v_status_events"""),
    ("a", """SELECT job_id, min(rn) FILTER (WHERE status = 'cancelled') AS c_rn, max(rn) AS l_rn,
             max(rn) FILTER (WHERE status <> 'completed') AS o_rn, min(rn) FILTER (WHERE status = 'processing') AS p_rn,
             count(*) AS events FROM e GROUP BY job_id"""),
])


def _status_events(t):
    ev = V.v_status_events(t)
    return ev.withColumn("error", F.when(F.col("status") == "failed",
                                         F.concat(F.lit("failed with value "), F.col("value").cast("string"))))


def _lifecycle(spark, d):
    return WK.job_lifecycle(_status_events(Tables(spark, d)), error="error")


@register("job_lifecycle", LIFECYCLE_SQL)
def q_job_lifecycle(spark, d):
    return _lifecycle(spark, d)


AGENT_RESULTS_SQL = """
SELECT user_id * 1000 + day(ts) AS job_id, event_id, ts, props AS payload,
  CASE event_type WHEN 'click' THEN 'extractor' WHEN 'view' THEN 'analyzer' WHEN 'purchase' THEN 'interviewer'
    WHEN 'signup' THEN 'charter' ELSE 'orchestrator' END AS agent,
  CASE WHEN value < 50 THEN 'cv' ELSE 'job' END AS part,
  CASE WHEN event_type = 'error' THEN 'agent error ' || CAST(event_id AS VARCHAR) END AS error
FROM events"""

AGENTS = ["extractor", "analyzer", "interviewer", "charter"]


def _agent_results(t):
    e = t.events
    et = F.col("event_type")
    return e.select(
        (F.col("user_id") * 1000 + F.dayofmonth("ts")).alias("job_id"), "event_id", "ts", F.col("props").alias("payload"),
        F.when(et == "click", "extractor").when(et == "view", "analyzer").when(et == "purchase", "interviewer")
        .when(et == "signup", "charter").otherwise("orchestrator").alias("agent"),
        F.when(F.col("value") < 50, "cv").otherwise("job").alias("part"),
        F.when(et == "error", F.concat(F.lit("agent error "), F.col("event_id").cast("string"))).alias("error"))


@register("payload_merge", W([], """
SELECT job_id,
  arg_max(payload, (ts, event_id)) FILTER (WHERE agent = 'extractor' AND part = 'cv') AS extractor_cv_payload,
  arg_max(payload, (ts, event_id)) FILTER (WHERE agent = 'extractor' AND part = 'job') AS extractor_job_payload,
  arg_max(payload, (ts, event_id)) FILTER (WHERE agent = 'analyzer') AS analyzer_payload,
  arg_max(payload, (ts, event_id)) FILTER (WHERE agent = 'interviewer') AS interviewer_payload,
  arg_max(payload, (ts, event_id)) FILTER (WHERE agent = 'charter') AS charter_payload,
  arg_max(error, (ts, event_id)) FILTER (WHERE error IS NOT NULL) AS error,
  max(ts) AS updated_at
FROM r GROUP BY job_id""", extra=[("r", AGENT_RESULTS_SQL)]))
def q_payload_merge(spark, d):
    return WK.payload_merge(_agent_results(Tables(spark, d)), AGENTS, part="part")


PLAN = {"full_analysis": ["extractor", "analyzer", "interviewer"], "gap_analysis": ["extractor", "analyzer"],
        "cv_parse": ["extractor"]}


@register("missing_steps", W([], """
SELECT j.job_id, j.job_type, p.step, p.step_order FROM jobs j JOIN plan p ON j.job_type = p.job_type
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.job_id = j.job_id AND r.agent = p.step)""", extra=[
    ("r", AGENT_RESULTS_SQL),
    ("jobs", """SELECT DISTINCT job_id, CASE job_id % 3 WHEN 0 THEN 'full_analysis' WHEN 1 THEN 'gap_analysis'
                ELSE 'cv_parse' END AS job_type FROM r"""),
    ("plan", "SELECT * FROM (VALUES " + ", ".join(
        f"('{t}', '{s}', {i})" for t, steps in PLAN.items() for i, s in enumerate(steps)) + ") p(job_type, step, step_order)"),
]))
def q_missing_steps(spark, d):
    r = _agent_results(Tables(spark, d))
    jid = F.col("job_id")
    jobs = r.select("job_id").distinct().withColumn(
        "job_type", F.when(jid % 3 == 0, "full_analysis").when(jid % 3 == 1, "gap_analysis").otherwise("cv_parse"))
    done = r.select("job_id", F.col("agent").alias("step")).distinct()
    return WK.missing_steps(jobs, done, PLAN)


@register("stuck_jobs", W([], """
SELECT * FROM (SELECT *, CAST(trunc((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_event_at)) / 1000000)
  AS BIGINT) AS age_seconds FROM lc) WHERE state IN ('pending', 'processing') AND age_seconds > 910""",
    extra=[("lc", LIFECYCLE_SQL)]))
def q_stuck_jobs(spark, d):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return WK.stuck_jobs(_lifecycle(spark, d), now, WK.QUEUE_VISIBILITY_SECONDS)


@register("answers_latest", """
SELECT conv_id AS session_id, turn % 3 AS question_id, arg_max(text, turn) AS answer, count(*) AS attempts,
  max(turn) AS answered_at
FROM conversations WHERE role = 'user' GROUP BY 1, 2""")
def q_answers_latest(spark, d):
    cv = Tables(spark, d).conversations.where(F.col("role") == "user").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") % 3).alias("question_id"), "turn",
        F.col("text").alias("answer"))
    return WK.answer_upsert(cv)


def _expiring(t):
    return V.v_postings(t).withColumn("expires_at", F.timestamp_add("DAY", F.lit(20), F.col("discovered_at")))


EXPIRING_SQL = "SELECT *, discovered_at + INTERVAL 20 DAY AS expires_at FROM v_postings"
NOW_SQL = "TIMESTAMP '2024-01-20 00:00:00'"


@register("active_postings", W(["v_postings"], f"""
SELECT * FROM x WHERE is_active AND (expires_at IS NULL OR expires_at > {NOW_SQL})""", extra=[("x", EXPIRING_SQL)]))
def q_active_postings(spark, d):
    return WK.active_postings(_expiring(Tables(spark, d)), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@register("expire_pass", W(["v_postings"], f"""
SELECT * REPLACE (is_active AND (expires_at IS NULL OR expires_at > {NOW_SQL}) AS is_active) FROM x""",
    extra=[("x", EXPIRING_SQL)]))
def q_expire_pass(spark, d):
    return WK.expire_pass(_expiring(Tables(spark, d)), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


CHANGES_SQL = """
SELECT l_orderkey AS app_id, l_linenumber, l_partkey, l_suppkey, l_shipdate AS ts,
  CASE l_linenumber WHEN 1 THEN 'saved' WHEN 2 THEN 'applied' WHEN 3 THEN 'screening' WHEN 4 THEN 'interview'
    WHEN 5 THEN 'applied' WHEN 6 THEN 'offer' ELSE 'cancelled' END AS status,
  CASE WHEN l_linenumber % 2 = 0 THEN 'note ' || CAST(l_partkey AS VARCHAR) ELSE '' END AS notes
FROM lineitem"""


@register("application_state", W([], """
SELECT app_id,
  arg_max(status, (ts, l_linenumber, l_partkey, l_suppkey, status)) FILTER (WHERE status IN
    ('saved', 'applied', 'screening', 'phone_screen', 'interview', 'technical', 'onsite', 'offer', 'rejected', 'withdrawn',
     'accepted')) AS status,
  max(ts) FILTER (WHERE status IN ('saved', 'applied', 'screening', 'phone_screen', 'interview', 'technical', 'onsite',
    'offer', 'rejected', 'withdrawn', 'accepted')) AS last_status_change,
  max(ts) FILTER (WHERE status = 'applied') AS applied_at,
  arg_max(notes, (ts, l_linenumber, l_partkey, l_suppkey, notes)) FILTER (WHERE coalesce(trim(notes), '') <> '') AS notes,
  CAST(count(*) FILTER (WHERE status NOT IN ('saved', 'applied', 'screening', 'phone_screen', 'interview', 'technical',
    'onsite', 'offer', 'rejected', 'withdrawn', 'accepted')) AS BIGINT) AS rejected_changes
FROM ch GROUP BY app_id""", extra=[("ch", CHANGES_SQL)]))
def q_application_state(spark, d):
    li = Tables(spark, d).lineitem
    n = F.col("l_linenumber")
    ch = li.select(
        F.col("l_orderkey").alias("app_id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("ts"),
        F.when(n == 1, "saved").when(n == 2, "applied").when(n == 3, "screening").when(n == 4, "interview")
        .when(n == 5, "applied").when(n == 6, "offer").otherwise("cancelled").alias("status"),
        F.when(n % 2 == 0, F.concat(F.lit("note "), F.col("l_partkey").cast("string"))).otherwise(F.lit("")).alias("notes"))
    return WK.application_state(ch, order=["l_linenumber", "l_partkey", "l_suppkey"])
