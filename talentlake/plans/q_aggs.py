"""Registered queries for the D operators (aggregations)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talentlake.operators import aggs
from talentlake.plans import views as V
from talentlake.plans.oracle_views import with_views as W
from talentlake.plans.registry import register
from talentlake.session import scratch_path
from talentlake.sources.tables import Tables


@register("pipeline_stats", W(["v_applications"], """
SELECT user_id, status, count(*) AS count, min(created_at) AS earliest, max(created_at) AS latest
FROM v_applications GROUP BY user_id, status"""))
def q_pipeline_stats(spark, d):
    return aggs.pipeline_stats(V.v_applications(Tables(spark, d)))


@register("status_breakdown", W(["v_applications"], """
SELECT user_id, coalesce(status, 'unknown') AS status, count(*) AS count,
  coalesce(round(100 * count(*) / nullif(sum(count(*)) OVER (PARTITION BY user_id), 0), 1), 0.0) AS pct
FROM v_applications GROUP BY user_id, coalesce(status, 'unknown')"""))
def q_status_breakdown(spark, d):
    return aggs.status_breakdown(V.v_applications(Tables(spark, d)), by="user_id")


@register("stage_funnel", W(["v_applications"], """
SELECT user_id, total, saved, applied, interview, offer,
  round(100 * interview / nullif(applied, 0), 1) AS response_rate,
  round(100 * offer / nullif(interview, 0), 1) AS offer_rate
FROM (SELECT user_id, count(*) AS total, CAST(count_if(status = 'saved') AS BIGINT) AS saved,
        CAST(count_if(status IN ('applied', 'screening')) AS BIGINT) AS applied,
        CAST(count_if(status IN ('phone_screen', 'interview', 'technical', 'onsite')) AS BIGINT) AS interview,
        CAST(count_if(status IN ('offer', 'accepted')) AS BIGINT) AS offer
      FROM v_applications GROUP BY user_id)"""))
def q_stage_funnel(spark, d):
    return aggs.stage_funnel(V.v_applications(Tables(spark, d)), by="user_id")


@register("application_funnel", W(["v_applications"], """
SELECT user_id, total_saved, total_applied, total_responses, total_interviews, total_offers,
  round(100 * total_responses / nullif(total_applied, 0), 1) AS response_rate,
  round(100 * total_interviews / nullif(total_applied, 0), 1) AS interview_rate,
  round(100 * total_offers / nullif(total_interviews, 0), 1) AS offer_rate
FROM (SELECT user_id, count(*) AS total_saved, count(applied_at) AS total_applied,
        count(response_date) AS total_responses,
        CAST(count_if(status IN ('phone_screen', 'interview', 'technical', 'onsite', 'offer', 'accepted')) AS BIGINT) AS total_interviews,
        CAST(count_if(status IN ('offer', 'accepted')) AS BIGINT) AS total_offers
      FROM v_applications GROUP BY user_id)"""))
def q_application_funnel(spark, d):
    return aggs.application_funnel(V.v_applications(Tables(spark, d)), by="user_id")


@register("gap_frequency", W(["v_gaps"], """
SELECT coalesce(missing_element, requirement, 'Unknown') AS skill, count(*) AS count
FROM v_gaps GROUP BY 1 ORDER BY count DESC, skill ASC LIMIT 10"""))
def q_gap_frequency(spark, d):
    return aggs.gap_frequency(V.v_gaps(Tables(spark, d)), k=10)


@register("skill_gap_profile", W(["v_gaps"], """
SELECT a.skill, a.frequency,
  CASE CAST(round(a.sev) AS INT) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' WHEN 4 THEN 'critical' END
    AS average_severity,
  r.recommendation, coalesce(r.n, 0) AS recommendation_count
FROM (SELECT skill, count(DISTINCT app_id) AS frequency,
        avg(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END) AS sev
      FROM g GROUP BY skill) a
LEFT JOIN (SELECT skill, recommendation, count(*) AS n FROM g WHERE recommendation IS NOT NULL GROUP BY ALL) r
  ON a.skill = r.skill""",
    extra=[("g", "SELECT coalesce(missing_element, requirement, 'Unknown') AS skill, app_id, severity, recommendation FROM v_gaps")]))
def q_skill_gap_profile(spark, d):
    return aggs.skill_gap_profile(V.v_gaps(Tables(spark, d)))


@register("role_breakdown", W(["v_applications"], """
SELECT coalesce(role_title, 'Unknown') AS role, count(*) AS count
FROM v_applications GROUP BY 1 ORDER BY count DESC, role LIMIT 8"""))
def q_role_breakdown(spark, d):
    return aggs.role_breakdown(V.v_applications(Tables(spark, d)), k=8)


@register("avg_fit", W(["v_applications"], """
SELECT user_id, round(avg(nullif(fit_score, 0)), 1) AS avg_fit, count(nullif(fit_score, 0)) AS scored
FROM v_applications GROUP BY user_id"""))
def q_avg_fit(spark, d):
    return aggs.avg_fit(V.v_applications(Tables(spark, d)), by="user_id")


@register("fit_bands", W(["v_analyses"], """
SELECT b.band_order, b.band, coalesce(c.count, 0) AS count
FROM (VALUES (0, '90-100'), (1, '75-89'), (2, '60-74'), (3, 'Below 60')) b(band_order, band)
LEFT JOIN (SELECT CASE WHEN fit_score >= 90 THEN '90-100' WHEN fit_score >= 75 THEN '75-89'
                  WHEN fit_score >= 60 THEN '60-74' ELSE 'Below 60' END AS band, count(*) AS count
           FROM v_analyses WHERE fit_score IS NOT NULL GROUP BY 1) c ON b.band = c.band"""))
def q_fit_bands(spark, d):
    return aggs.fit_bands(V.v_analyses(Tables(spark, d)), scheme="chart")


def _bands_sql(bands):
    case = " ".join(f"WHEN fit_score >= {low} THEN '{label}'" for low, label in bands[:-1])
    dim = ", ".join(f"({i}, '{label}')" for i, (_, label) in enumerate(bands))
    return f"""
SELECT b.band_order, b.band, coalesce(c.count, 0) AS count FROM (VALUES {dim}) b(band_order, band)
LEFT JOIN (SELECT CASE {case} ELSE '{bands[-1][1]}' END AS band, count(*) AS count
           FROM v_analyses WHERE fit_score IS NOT NULL GROUP BY 1) c ON b.band = c.band"""


@register("fit_bands_prompt", W(["v_analyses"], _bands_sql(
    [(90, "Excellent"), (75, "Strong"), (60, "Moderate"), (40, "Partial"), (0, "Poor")])))
def q_fit_bands_prompt(spark, d):
    return aggs.fit_bands(V.v_analyses(Tables(spark, d)), scheme="prompt")


@register("fit_bands_ui", W(["v_analyses"], _bands_sql([(80, "Excellent"), (60, "Good"), (40, "Fair"), (0, "Poor")])))
def q_fit_bands_ui(spark, d):
    return aggs.fit_bands(V.v_analyses(Tables(spark, d)), scheme="ui")


@register("dashboard_kpis", W(["v_cv", "v_applications", "v_analyses"], """
SELECT c.c_custkey AS user_id, coalesce(cv.n, 0) AS cv_count, coalesce(j.n, 0) AS job_count,
  coalesce(a.n, 0) AS analysis_count, CASE WHEN a.fit <> 0 THEN round_even(a.fit, 1) END AS avg_fit
FROM customer c
LEFT JOIN (SELECT user_id, count(*) AS n FROM v_cv GROUP BY user_id) cv ON cv.user_id = c.c_custkey
LEFT JOIN (SELECT user_id, count(*) AS n FROM v_applications GROUP BY user_id) j ON j.user_id = c.c_custkey
LEFT JOIN (SELECT p.user_id, count(*) AS n, avg(a.fit_score) AS fit
           FROM v_analyses a JOIN v_applications p ON a.job_id = p.id GROUP BY p.user_id) a ON a.user_id = c.c_custkey"""))
def q_dashboard_kpis(spark, d):
    t = Tables(spark, d)
    users = t.customer.select(F.col("c_custkey").alias("user_id"))
    apps = V.v_applications(t)
    return aggs.dashboard_kpis(users, V.v_cv(t), apps, V.v_analyses(t))


@register("insight_summary", W(["v_findings"], """
SELECT CASE WHEN grouping(category) = 1 THEN 'total' ELSE category END AS category, count(*) AS count,
  CAST(grouping(category) AS BIGINT) AS level
FROM v_findings GROUP BY GROUPING SETS ((category), ())"""))
def q_insight_summary(spark, d):
    return aggs.insight_summary(V.v_findings(Tables(spark, d)))


@register("source_summary", W(["v_postings"], """
SELECT lower(source) AS source, count(*) AS count, max(discovered_at) AS latest_discovery,
  CAST(grouping(lower(source)) AS BIGINT) AS level
FROM v_postings WHERE is_active GROUP BY ROLLUP (lower(source))"""))
def q_source_summary(spark, d):
    return aggs.source_summary(V.v_postings(Tables(spark, d)))


@register("response_by_role", W(["v_applications"], """
SELECT role_title, count(*) AS n, count(response_date) AS responses,
  round(100 * count(response_date) / nullif(count(*), 0), 1) AS response_rate
FROM v_applications GROUP BY role_title HAVING count(*) >= 1"""))
def q_response_by_role(spark, d):
    return aggs.response_rates(V.v_applications(Tables(spark, d)), "role_title", min_n=1)


@register("top_companies", W(["v_applications"], """
SELECT company_name, n, responses, response_rate FROM (
  SELECT company_name, count(*) AS n, count(response_date) AS responses,
    round(100 * count(response_date) / nullif(count(*), 0), 1) AS response_rate
  FROM v_applications GROUP BY company_name HAVING count(*) >= 20)
ORDER BY response_rate DESC, n DESC, company_name LIMIT 5"""))
def q_top_companies(spark, d):
    return aggs.top_by_response(V.v_applications(Tables(spark, d)), "company_name", k=5, min_n=20)


@register("best_cv", W(["v_applications", "v_cv"], """
SELECT user_id, version_name, n, responses, response_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY response_rate DESC, n DESC, version_name) AS rn FROM (
    SELECT a.user_id, c.version_name, count(*) AS n, count(a.response_date) AS responses,
      round(100 * count(a.response_date) / nullif(count(*), 0), 1) AS response_rate
    FROM v_applications a JOIN v_cv c ON a.id = c.id GROUP BY a.user_id, c.version_name))
WHERE rn = 1"""))
def q_best_cv(spark, d):
    t = Tables(spark, d)
    apps = V.v_applications(t).join(V.v_cv(t).select("id", "version_name"), "id")
    return aggs.best_by_response(apps, "version_name", by="user_id")


@register("time_to_response", W(["v_applications"], """
SELECT role_title, count(*) AS responses, round(avg(dd), 2) AS avg_days,
  round(quantile_cont(dd, 0.5), 2) AS p50_days, round(quantile_cont(dd, 0.9), 2) AS p90_days
FROM (SELECT role_title, datediff('day', applied_at, response_date) AS dd FROM v_applications
      WHERE applied_at IS NOT NULL AND response_date IS NOT NULL) GROUP BY role_title"""))
def q_time_to_response(spark, d):
    return aggs.time_to_response(V.v_applications(Tables(spark, d)), by="role_title")


@register("response_histogram", W(["v_applications"], """
SELECT CASE WHEN dd <= 7 THEN '0-7' WHEN dd <= 14 THEN '8-14' WHEN dd <= 30 THEN '15-30' ELSE '30+' END AS bucket,
  count(*) AS count
FROM (SELECT datediff('day', applied_at, response_date) AS dd FROM v_applications
      WHERE applied_at IS NOT NULL AND response_date IS NOT NULL) GROUP BY 1"""))
def q_response_histogram(spark, d):
    return aggs.response_histogram(V.v_applications(Tables(spark, d)))


@register("apps_by_month", W(["v_applications"], """
SELECT cal.period, coalesce(c.count, 0) AS count
FROM (SELECT unnest(generate_series(min(p), max(p), INTERVAL 1 MONTH)) AS period
      FROM (SELECT date_trunc('month', created_at) AS p FROM v_applications)) cal
LEFT JOIN (SELECT date_trunc('month', created_at) AS period, count(*) AS count FROM v_applications GROUP BY 1) c
  ON cal.period = c.period"""))
def q_apps_by_month(spark, d):
    return aggs.application_trend(V.v_applications(Tables(spark, d)), grain="month")


@register("session_scores", W(["v_evaluations"], """
SELECT session_id, count(*) AS answers, round(avg(score), 2) AS avg_score, round(avg(clarity), 2) AS avg_clarity,
  round(avg(relevance), 2) AS avg_relevance, round(avg(depth), 2) AS avg_depth,
  round(avg(CAST(star_method_used AS INT)), 3) AS star_share, CAST(round(avg(score) * 20) AS INT) AS overall_score
FROM v_evaluations GROUP BY session_id"""))
def q_session_scores(spark, d):
    return aggs.session_scores(V.v_evaluations(Tables(spark, d)))


@register("skill_demand", W(["v_posting_skills"], """
SELECT skill, count(DISTINCT posting_id) AS postings, count(DISTINCT company) AS companies,
  round(100 * count(DISTINCT posting_id) / (SELECT count(DISTINCT posting_id) FROM v_posting_skills), 2) AS share
FROM v_posting_skills GROUP BY skill"""))
def q_skill_demand(spark, d):
    return aggs.skill_demand(V.v_posting_skills(Tables(spark, d)))


@register("skill_demand_approx", W(["v_posting_skills"], """
SELECT DISTINCT skill, true AS postings_within, true AS companies_within FROM v_posting_skills"""))
def q_skill_demand_approx(spark, d):
    """Whether the sketch's counts lie within four times its relative error of the exact ones."""
    rows = V.v_posting_skills(Tables(spark, d))
    exact = aggs.skill_demand(rows).select("skill", F.col("postings").alias("p"), F.col("companies").alias("c"))
    near = aggs.skill_demand_approx(rows, rsd=0.02).join(exact, "skill")
    within = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 4 * 0.02 * F.col(b)
    return near.select("skill", within("postings", "p").alias("postings_within"), within("companies", "c").alias("companies_within"))


def _demand_sketches(spark, d):
    """Postings by the day they were found, added in three calls; the second call brings a day of the first again."""
    t = Tables(spark, d)
    day = V.v_postings(t).select(F.col("id").alias("posting_id"), F.to_date("discovered_at").alias("period"))
    rows = V.v_posting_skills(t).join(day, "posting_id")
    kept = aggs.DemandSketches(spark, scratch_path(spark, "demand"))
    week = F.dayofmonth("period") < 8
    for part in (week, ~week | (F.dayofmonth("period") == 3), F.dayofmonth("period") == 9):
        kept.add(rows.where(part))
    return kept, rows


@register("skill_demand_periods", W(["v_posting_skills"], """
SELECT DISTINCT skill, true AS postings_within, true AS companies_within FROM v_posting_skills"""))
def q_skill_demand_periods(spark, d):
    """Whether the union of all days' sketches lies within four times its relative error of the exact counts."""
    kept, rows = _demand_sketches(spark, d)
    exact = aggs.skill_demand(rows).select("skill", F.col("postings").alias("p"), F.col("companies").alias("c"))
    near = kept.demand().join(exact, "skill")
    within = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 4 * 1.04 / 64 * F.col(b)
    return near.select("skill", within("postings", "p").alias("postings_within"), within("companies", "c").alias("companies_within"))


@register("top_skills_periods", W(["v_posting_skills"], """
SELECT CAST(row_number() OVER (ORDER BY n DESC) AS INT) AS place, n AS count
FROM (SELECT count(*) AS n FROM v_posting_skills GROUP BY skill ORDER BY n DESC LIMIT 20)"""))
def q_top_skills_periods(spark, d):
    """The 20 most frequent skills out of all days' sketches (fewer skills than counters: exact counts)."""
    top = _demand_sketches(spark, d)[0].top(20)
    return top.select(F.row_number().over(Window.orderBy(F.desc("count"))).alias("place"), "count")


@register("salary_overall", W(["v_postings"], """
SELECT count(*) AS postings, count(mid) AS with_salary, round(100 * count(mid) / nullif(count(*), 0), 1) AS coverage_pct,
  min(mid) AS min_mid, round(quantile_cont(mid, 0.25), 2) AS p25_mid, round(quantile_cont(mid, 0.5), 2) AS median_mid,
  round(quantile_cont(mid, 0.75), 2) AS p75_mid, max(mid) AS max_mid, round(avg(mid), 2) AS avg_mid
FROM (SELECT CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN (salary_min + salary_max) / 2.0
             ELSE CAST(coalesce(salary_min, salary_max) AS DOUBLE) END AS mid FROM v_postings)"""))
def q_salary_overall(spark, d):
    return aggs.salary_insight(V.v_postings(Tables(spark, d)), by=[])


@register("salary_insight", W(["v_postings"], """
SELECT location, count(*) AS postings, count(mid) AS with_salary, round(100 * count(mid) / nullif(count(*), 0), 1) AS coverage_pct,
  min(mid) AS min_mid, round(quantile_cont(mid, 0.25), 2) AS p25_mid, round(quantile_cont(mid, 0.5), 2) AS median_mid,
  round(quantile_cont(mid, 0.75), 2) AS p75_mid, max(mid) AS max_mid, round(avg(mid), 2) AS avg_mid
FROM (SELECT location, CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN (salary_min + salary_max) / 2.0
             ELSE CAST(coalesce(salary_min, salary_max) AS DOUBLE) END AS mid FROM v_postings)
GROUP BY location"""))
def q_salary_insight(spark, d):
    return aggs.salary_insight(V.v_postings(Tables(spark, d)), by="location")


@register("role_trend", """
SELECT role, period, count, prev_count,
  round(100 * (count - prev_count) / prev_count, 1) AS change_pct,
  CAST(dense_rank() OVER (PARTITION BY period ORDER BY count DESC) AS INTEGER) AS rank_in_period
FROM (SELECT role, period, count, lag(count) OVER (PARTITION BY role ORDER BY period) AS prev_count
      FROM (SELECT o_orderpriority AS role, date_trunc('year', o_orderdate) AS period, count(*) AS count
            FROM orders GROUP BY 1, 2))""")
def q_role_trend(spark, d):
    o = Tables(spark, d).orders
    return aggs.role_trend(o, role="o_orderpriority", ts="o_orderdate", grain="year").withColumnRenamed(
        "o_orderpriority", "role")


@register("response_by_month", W(["v_applications"], """
SELECT month, count(*) AS n, count(response_date) AS responses,
  round(100 * count(response_date) / nullif(count(*), 0), 1) AS response_rate
FROM (SELECT *, date_trunc('month', created_at) AS month FROM v_applications) GROUP BY month"""))
def q_response_by_month(spark, d):
    apps = V.v_applications(Tables(spark, d)).withColumn(
        "month", F.date_trunc("month", F.col("created_at")).cast("timestamp_ntz"))
    return aggs.response_rates(apps, "month")


@register("score_labels", W(["v_analyses", "v_gaps"], """
SELECT 'fit' AS kind, CASE WHEN fit_score >= 80 THEN 'Excellent' WHEN fit_score >= 60 THEN 'Good'
    WHEN fit_score >= 40 THEN 'Fair' ELSE 'Poor' END AS label, count(*) AS count
FROM v_analyses WHERE fit_score IS NOT NULL GROUP BY 1, 2
UNION ALL
SELECT 'severity', CAST(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END
    AS VARCHAR), count(*) FROM v_gaps GROUP BY 1, 2"""))
def q_score_labels(spark, d):
    t = Tables(spark, d)
    fit = V.v_analyses(t).where(F.col("fit_score").isNotNull()).groupBy(
        F.lit("fit").alias("kind"), aggs.fit_band(F.col("fit_score"), "ui").alias("label")).agg(
        F.count(F.lit(1)).alias("count"))
    sev = V.v_gaps(t).groupBy(F.lit("severity").alias("kind"),
                              aggs.severity_rank("severity").cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("count"))
    return fit.unionByName(sev)


@register("gap_frequency_approx", W(["v_gaps"], """
SELECT label, true AS within_bound FROM (
  SELECT coalesce(missing_element, requirement, 'Unknown') AS label, count(*) AS n FROM v_gaps GROUP BY 1 ORDER BY n DESC, label LIMIT 10)"""))
def q_gap_frequency_approx(spark, d):
    """The sketch's labels and whether its counts lie within one percent of the exact ones."""
    g = V.v_gaps(Tables(spark, d))
    label = F.coalesce(F.col("missing_element"), F.col("requirement"), F.lit("Unknown"))
    exact = g.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("exact"))
    near = aggs.top_k_approx(g, label, 10).join(exact, "label")
    return near.select("label", (F.abs(F.col("count") - F.col("exact")) <= 0.01 * F.col("exact")).alias("within_bound"))
