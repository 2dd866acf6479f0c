"""Registered queries for the E (ranking) and S (set) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentlake.functions.columns import ats_score
from talentlake.operators import ranking as R
from talentlake.operators import sets as S
from talentlake.operators.common import words
from talentlake.plans import views as V
from talentlake.plans.oracle_views import with_views as W
from talentlake.plans.registry import register
from talentlake.sources.tables import Tables

WORDS_RE = r"[^\p{L}\p{N}]+"


@register("latest_n", W(["v_analyses"], """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cv_version_id
                 ORDER BY created_at DESC NULLS FIRST, id) AS INT) AS rank FROM v_analyses)
WHERE rank <= 5"""))
def q_latest_n(spark, d):
    return R.latest_n(V.v_analyses(Tables(spark, d)), "cv_version_id", "created_at", 5)


@register("latest_completed", W(["v_analyses"], """
SELECT job_id, id, cv_version_id, fit_score, ats_score, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id DESC) AS rn
  FROM v_analyses WHERE ats_score >= 50) WHERE rn = 1"""))
def q_latest_completed(spark, d):
    ga = V.v_analyses(Tables(spark, d))
    return R.latest_per_key(ga, "job_id", "created_at", pred=F.col("ats_score") >= 50)


@register("default_cv", W(["v_cv"], """
SELECT id, user_id, version_name, is_primary, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY is_primary DESC NULLS LAST,
    created_at DESC NULLS FIRST, id) AS rn FROM v_cv) WHERE rn = 1"""))
def q_default_cv(spark, d):
    return R.default_cv(V.v_cv(Tables(spark, d)))


FEED_ORDER_SQL = "is_featured DESC NULLS FIRST, relevance_score DESC NULLS FIRST, created_at DESC NULLS FIRST, id"


@register("ranked_feed", W(["v_findings"], f"""
SELECT * FROM v_findings ORDER BY {FEED_ORDER_SQL} LIMIT 50 OFFSET 0"""))
def q_ranked_feed(spark, d):
    return R.ranked_feed(V.v_findings(Tables(spark, d)), R.findings_order(), limit=100, offset=0, cap=50)


@register("ranked_feed_page2", W(["v_findings"], f"""
SELECT * FROM v_findings WHERE category = 'skill_demand' ORDER BY {FEED_ORDER_SQL} LIMIT 20 OFFSET 20"""))
def q_ranked_feed_page2(spark, d):
    f = V.v_findings(Tables(spark, d)).where(F.col("category") == "skill_demand")
    return R.ranked_feed(f, R.findings_order(), limit=20, offset=20, cap=50)


@register("ranked_feed_total", W(["v_findings"], f"""
SELECT *, (SELECT count(*) FROM v_findings WHERE category = 'salary_insight') AS total FROM v_findings
WHERE category = 'salary_insight' ORDER BY {FEED_ORDER_SQL} LIMIT 20 OFFSET 10"""))
def q_ranked_feed_total(spark, d):
    f = V.v_findings(Tables(spark, d)).where(F.col("category") == "salary_insight")
    return R.feed_page(f, R.findings_order(), limit=20, offset=10)


@register("trending_roles", W(["v_findings"], f"""
SELECT * FROM v_findings WHERE category = 'role_trend' ORDER BY {FEED_ORDER_SQL} LIMIT 20"""))
def q_trending_roles(spark, d):
    f = V.v_findings(Tables(spark, d)).where(F.col("category") == "role_trend")
    return R.ranked_feed(f, R.findings_order(), limit=25, cap=20)


DEDUPE_INPUT_SQL = """
SELECT id, source, CASE WHEN id % 11 = 0 THEN '' ELSE source_job_id END AS source_job_id, role_title, company_name,
  location, discovered_at FROM v_postings"""


def _dedupe_input(t):
    p = V.v_postings(t)
    return p.select("id", "source", F.when(F.col("id") % 11 == 0, F.lit("")).otherwise(F.col("source_job_id")).alias(
        "source_job_id"), "role_title", "company_name", "location", "discovered_at")


@register("dedupe_first", W(["v_postings"], """
SELECT dedupe_key, id, source, source_job_id, role_title, company_name, location, discovered_at FROM (
  SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY discovered_at, id) AS rn FROM (
    SELECT *, coalesce(nullif(source_job_id, ''), nullif(coalesce(role_title, '') || coalesce(company_name, ''), '')) AS dedupe_key
    FROM inp) WHERE dedupe_key IS NOT NULL) WHERE rn = 1""", extra=[("inp", DEDUPE_INPUT_SQL)]))
def q_dedupe_first(spark, d):
    return R.dedupe_first(_dedupe_input(Tables(spark, d)), R.dedupe_key(), ["discovered_at", "id"])


@register("single_primary", W(["v_cv"], """
SELECT c.id, c.user_id, c.version_name, c.created_at,
  CASE WHEN l.pcv IS NOT NULL THEN c.id = l.pcv ELSE coalesce(c.is_primary, false) END AS is_primary
FROM v_cv c LEFT JOIN (
  SELECT user_id, id AS pcv FROM (
    SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
    FROM v_cv WHERE is_primary) WHERE rn = 1) l ON c.user_id = l.user_id"""))
def q_single_primary(spark, d):
    cv = V.v_cv(Tables(spark, d))
    changes = cv.where("is_primary").select(F.col("id").alias("cv_id"), "user_id", F.col("created_at").alias("ts"))
    return R.enforce_single_primary(cv, changes)


@register("pending_queue", W(["v_status_events"], """
SELECT event_id AS id, job_id, status, ts AS created_at FROM v_status_events WHERE status = 'pending'
ORDER BY created_at, id LIMIT 20"""))
def q_pending_queue(spark, d):
    ev = V.v_status_events(Tables(spark, d)).select(
        F.col("event_id").alias("id"), "job_id", "status", F.col("ts").alias("created_at"))
    return R.pending_queue(ev, 20)


@register("union_sources", """
SELECT item_id AS id, text FROM benchmark
UNION ALL BY NAME
SELECT doc_id AS id, text, lang FROM documents""")
def q_union_sources(spark, d):
    t = Tables(spark, d)
    return S.union_sources([t.benchmark.select(F.col("item_id").alias("id"), "text"),
                            t.documents.select(F.col("doc_id").alias("id"), "text", "lang")])


# Keyword sets per application: the posting asks for the words of all its parts' names,
# the CV holds the words of the parts on finished lines.
KW_SQL = f"""
SELECT app_id, job_kw, coalesce(cv_kw, []::VARCHAR[]) AS cv_kw FROM (
  SELECT l.l_orderkey AS app_id,
    list_distinct(flatten(list(regexp_split_to_array(lower(p.p_name), '{WORDS_RE}')))) AS job_kw,
    list_distinct(flatten(list(regexp_split_to_array(lower(p.p_name), '{WORDS_RE}'))
      FILTER (WHERE l.l_linestatus = 'F'))) AS cv_kw
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey)"""


def _kw_pairs(t):
    li, p = t.lineitem, t.part
    j = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("app_id"), "l_linestatus", words(F.col("p_name")).alias("_w"))
    g = j.groupBy("app_id").agg(
        F.array_distinct(F.flatten(F.collect_list("_w"))).alias("job_kw"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("l_linestatus") == "F", F.col("_w"))))).alias("cv_kw"),
    )
    return g


@register("keyword_sets", W([], """
SELECT app_id, list_sort(list_intersect(job_kw, cv_kw)) AS present,
  list_sort(list_filter(list_distinct(job_kw), lambda x: NOT list_contains(cv_kw, x))) AS missing FROM kw""",
    extra=[("kw", KW_SQL)]))
def q_keyword_sets(spark, d):
    g = _kw_pairs(Tables(spark, d))
    present, missing = S.keyword_sets(F.col("cv_kw"), F.col("job_kw"))
    return g.select("app_id", present.alias("present"), missing.alias("missing"))


@register("ats_score", W([], """
SELECT app_id, CAST(len(list_intersect(job_kw, cv_kw)) AS INT) AS n_present, CAST(len(job_kw) AS INT) AS n_keywords,
  CASE WHEN len(job_kw) = 0 THEN 0 ELSE CAST(round(100.0 * len(list_intersect(job_kw, cv_kw)) / len(job_kw)) AS INT) END
    AS ats_score FROM kw""", extra=[("kw", KW_SQL)]))
def q_ats_score(spark, d):
    g = _kw_pairs(Tables(spark, d))
    present, _ = S.keyword_sets(F.col("cv_kw"), F.col("job_kw"))
    return g.select("app_id", F.size(present).alias("n_present"), F.size("job_kw").alias("n_keywords"),
                    ats_score(present, F.col("job_kw")).alias("ats_score"))


@register("keyword_sets_rows", f"""
SELECT b.keyword, d.keyword IS NOT NULL AS present
FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '{WORDS_RE}')) AS keyword FROM benchmark) b
LEFT JOIN (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '{WORDS_RE}')) AS keyword FROM documents) d
  ON b.keyword = d.keyword
WHERE b.keyword <> ''""")
def q_keyword_sets_rows(spark, d):
    t = Tables(spark, d)
    job = t.benchmark.select(F.explode(words(F.col("text"))).alias("keyword"))
    cv = t.documents.select(F.explode(words(F.col("text"))).alias("keyword"))
    return S.keyword_sets_rows(cv, job)


# --------------------------------------------------------------------------- A1 paging
@register("list_newest", W(["v_cv"], """
SELECT * FROM v_cv ORDER BY created_at DESC NULLS FIRST, id LIMIT 100 OFFSET 0"""))
def q_list_newest(spark, d):
    from talentlake.sources.tables import list_newest

    return list_newest(V.v_cv(Tables(spark, d)), "created_at", "id", limit=100, offset=0)
