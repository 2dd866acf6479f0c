"""Registered queries for the C operators (joins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentlake.functions.columns import remote_policy
from talentlake.operators import joins as J
from talentlake.plans import views as V
from talentlake.plans.oracle_views import with_views as W
from talentlake.plans.registry import register
from talentlake.sources.tables import Tables

WORDS_RE = r"[^\p{L}\p{N}]+"


@register("recent_analyses", W(["v_analyses", "v_applications"], """
SELECT ga.id, ga.fit_score, ga.ats_score, ga.created_at, jp.company_name, jp.role_title, c.c_name AS cv_version
FROM v_analyses ga JOIN v_applications jp ON ga.job_id = jp.id JOIN customer c ON ga.cv_version_id = c.c_custkey"""))
def q_recent_analyses(spark, d):
    t = Tables(spark, d)
    cv = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("version_name"))
    return J.analyses_with_context(V.v_analyses(t), V.v_applications(t), cv)


@register("sessions_left", """
SELECT o.o_orderkey AS session_id, o.o_custkey AS user_id, o.o_orderdate AS created_at, o.o_orderkey AS job_id,
  l.l_linenumber AS pos, l.l_partkey AS part_id
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey""")
def q_sessions_left(spark, d):
    t = Tables(spark, d)
    s = t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"),
                        F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("job_id"))
    jp = t.lineitem.select(F.col("l_orderkey").alias("jp_job_id"), F.col("l_linenumber").alias("pos"),
                           F.col("l_partkey").alias("part_id"))
    return J.sessions_with_posting(s, jp, "job_id", "jp_job_id")


APPS_ENRICHED_SELECT = """
SELECT a.id, a.user_id, a.job_id, a.status, p.role_title AS posting_role, p.company_name AS posting_company,
  g.id AS analysis_id, g.fit_score AS analysis_fit, g.created_at AS analysis_at
FROM v_applications a LEFT JOIN v_postings p ON a.job_id = p.id LEFT JOIN {g} g ON a.job_id = g.job_id"""


def _apps(t):
    return V.v_applications(t).select("id", "user_id", "job_id", "status")


@register("apps_enriched", W(["v_applications", "v_postings", "v_analyses"], APPS_ENRICHED_SELECT.format(g="lg"),
                             extra=[("lg", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id
                                    ORDER BY created_at DESC, id DESC) AS rn FROM v_analyses) WHERE rn = 1""")]))
def q_apps_enriched(spark, d):
    t = Tables(spark, d)
    return J.applications_enriched(_apps(t), V.v_postings(t), V.v_analyses(t))


@register("apps_enriched_fanout", W(["v_applications", "v_postings", "v_analyses"],
                                    APPS_ENRICHED_SELECT.format(g="v_analyses")))
def q_apps_enriched_fanout(spark, d):
    t = Tables(spark, d)
    return J.applications_enriched(_apps(t), V.v_postings(t), V.v_analyses(t), fanout=True)


SAVE_SQL = [
    ("disc", """SELECT id, user_id, CASE WHEN job_id % 13 = 0 THEN NULL
                ELSE 'https://jobs.example/' || CAST(job_id % 97 AS VARCHAR) END AS source_url, role_title
                FROM v_applications"""),
    ("saved", """SELECT user_id, CASE WHEN id % 13 = 0 THEN NULL
                 ELSE 'https://jobs.example/' || CAST((id + 1) % 97 AS VARCHAR) END AS source_url,
                 version_name AS role_title FROM v_cv"""),
]


@register("not_yet_saved", W(["v_applications", "v_cv"], """
SELECT d.* FROM disc d WHERE NOT EXISTS (
  SELECT 1 FROM saved s WHERE s.user_id = d.user_id AND coalesce(s.source_url, '') = coalesce(d.source_url, '')
    AND coalesce(s.role_title, '') = coalesce(d.role_title, ''))""", extra=SAVE_SQL))
def q_not_yet_saved(spark, d):
    t = Tables(spark, d)
    a, c = V.v_applications(t), V.v_cv(t)
    url = lambda k: F.when(F.col(k) % 13 != 0, F.concat(F.lit("https://jobs.example/"), (F.col(k) % 97).cast("string")))
    disc = a.select("id", "user_id", url("job_id").alias("source_url"), "role_title")
    saved = c.select("user_id", F.when(F.col("id") % 13 != 0, F.concat(
        F.lit("https://jobs.example/"), ((F.col("id") + 1) % 97).cast("string"))).alias("source_url"),
        F.col("version_name").alias("role_title"))
    return J.not_yet_saved(disc, saved)


def _skill_dim(t):
    """Skill dictionary from part names: canonical = the noun, aliases = the full part names."""
    p = t.part
    return p.groupBy(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("name")).agg(
        F.array_sort(F.collect_set("p_name")).alias("aliases"))


@register("canonical_skills", W(["v_postings", "v_posting_skills"], """
SELECT i.id, i.skill, coalesce(m.canonical, i.skill) AS canonical_skill
FROM (SELECT id, role_title AS skill FROM v_postings UNION ALL SELECT posting_id AS id, skill FROM v_posting_skills) i
LEFT JOIN (SELECT alias_key, canonical FROM (
    SELECT alias_key, canonical, row_number() OVER (PARTITION BY alias_key ORDER BY pri, canonical) AS rn FROM (
      SELECT lower(trim(name)) AS alias_key, name AS canonical, 0 AS pri FROM dim
      UNION ALL SELECT lower(trim(a)) AS alias_key, name AS canonical, 1 AS pri FROM (SELECT name, unnest(aliases) AS a FROM dim))
    WHERE alias_key <> '') WHERE rn = 1) m ON lower(trim(i.skill)) = m.alias_key""",
    extra=[("dim", "SELECT split_part(p_name, ' ', 2) AS name, list_sort(list_distinct(list(p_name))) AS aliases "
                   "FROM part GROUP BY 1")]))
def q_canonical_skills(spark, d):
    t = Tables(spark, d)
    inp = V.v_postings(t).select("id", F.col("role_title").alias("skill")).unionByName(
        V.v_posting_skills(t).select(F.col("posting_id").alias("id"), "skill"))
    return J.canonical_skills(inp, _skill_dim(t))


MATCH_SQL = [
    ("pairs", "SELECT o_custkey AS cv_id, o_orderkey AS job_id FROM orders"),
    ("reqs", """SELECT l.l_orderkey AS job_id, l.l_linenumber AS req_id, p.p_type AS skill,
                CASE WHEN l.l_linenumber = 1 THEN NULL ELSE l.l_linenumber + 1 END AS years_required
                FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""),
    ("cvs", """SELECT o.o_custkey + 1 AS cv_id, p.p_type AS skill, CAST(CAST(l.l_quantity AS BIGINT) % 12 AS INT) AS years
               FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey"""),
]


@register("match_requirements", W([], """
SELECT r.cv_id, r.job_id, r.req_id, r.skill, r.years_required, c.cv_years,
  CASE WHEN c.skill IS NULL THEN 'missing'
       WHEN r.years_required IS NULL OR coalesce(c.cv_years, 0) >= r.years_required THEN 'met' ELSE 'short' END AS status
FROM (SELECT * FROM pairs JOIN reqs USING (job_id)) r
LEFT JOIN (SELECT cv_id, skill, max(years) AS cv_years FROM cvs GROUP BY cv_id, skill) c
  ON r.cv_id = c.cv_id AND r.skill = c.skill""", extra=MATCH_SQL))
def q_match_requirements(spark, d):
    t = Tables(spark, d)
    o, li, p = t.orders, t.lineitem, t.part
    pairs = o.select(F.col("o_custkey").alias("cv_id"), F.col("o_orderkey").alias("job_id"))
    lp = li.join(p, li.l_partkey == p.p_partkey)
    reqs = lp.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("req_id"),
                     F.col("p_type").alias("skill"),
                     F.when(F.col("l_linenumber") != 1, F.col("l_linenumber") + 1).alias("years_required"))
    cvs = o.join(lp, o.o_orderkey == lp.l_orderkey).select(
        (F.col("o_custkey") + 1).alias("cv_id"), F.col("p_type").alias("skill"),
        (F.col("l_quantity").cast("bigint") % 12).cast("int").alias("years"))
    return J.match_requirements(pairs, reqs, cvs)


PREF_SQL = [
    ("users", """SELECT user_id, unnest(CASE WHEN user_id % 10 = 0 THEN [role, left(role, 2), left(role, 1)] WHEN user_id % 10 = 1 THEN [role[2:5], ' ']
                   ELSE [role] END) AS role, unnest(CASE WHEN user_id % 10 < 2 THEN [loc, loc, loc][1:3 - user_id % 10] ELSE [loc] END) AS loc
                 FROM (SELECT c.c_custkey AS user_id, split_part(p.p_name, ' ', 2) AS role,
                   CASE WHEN c.c_custkey % 4 = 0 THEN left(n.n_name, 3) ELSE n.n_name END AS loc
                 FROM customer c JOIN part p ON p.p_partkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""),
    ("posts", """SELECT id, discovered_at, lower(role_title) AS t, lower(location) AS l,
                  lower(policy_text) LIKE '%remote%' AND lower(policy_text) NOT LIKE '%hybrid%' AS is_remote
                  FROM v_postings WHERE is_active"""),
]


@register("preference_match", W(["v_postings"], """
SELECT user_id, id, CAST(rank AS INT) AS rank FROM (
SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY discovered_at DESC, id) AS rank FROM (
SELECT DISTINCT u.user_id, p.id, p.discovered_at FROM users u JOIN posts p
  ON trim(u.role) <> '' AND p.t LIKE '%' || lower(trim(u.role)) || '%'
 AND (p.is_remote OR p.l LIKE '%' || lower(trim(u.loc)) || '%'))) WHERE rank <= 20""", extra=PREF_SQL))
def q_preference_match(spark, d):
    """Whole words, pieces of words, targets of two characters and of one, and a blank one."""
    t = Tables(spark, d)
    c, p, n = t.customer, t.part, t.nation
    role, some = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)), F.col("c_custkey") % 10
    roles = (F.when(some == 0, F.array(role, F.left(role, F.lit(2)), F.left(role, F.lit(1))))
             .when(some == 1, F.array(F.substring(role, 2, 4), F.lit(" "))).otherwise(F.array(role)))
    place = F.when(F.col("c_custkey") % 4 == 0, F.left("n_name", F.lit(3))).otherwise(F.col("n_name"))
    users = c.join(p, p.p_partkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("user_id"), roles.alias("target_roles"), F.array(place).alias("target_locations"))
    posts = V.v_postings(t).withColumn("remote_policy", remote_policy("policy_text"))
    newest = [-F.unix_micros(F.col("discovered_at").cast("timestamp"))]
    return J.preference_match(users, posts, order=newest, per_user=20)


@register("analysis_inputs", W(["v_cv", "v_applications"], """
SELECT r.request_id, r.user_id, r.cv_version_id, r.job_posting_id, c.version_name AS cv_version,
  j.role_title AS job_role, j.company_name AS job_company
FROM req r LEFT JOIN v_cv c ON c.id = r.cv_version_id AND c.user_id = r.user_id
LEFT JOIN v_applications j ON j.id = r.job_posting_id AND j.user_id = r.user_id""",
    extra=[("req", """SELECT o_orderkey AS request_id, o_custkey AS user_id,
            CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE o_orderkey - 1 END AS cv_version_id,
            CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey * 4 // 15 END AS job_posting_id FROM orders""")]))
def q_analysis_inputs(spark, d):
    t = Tables(spark, d)
    o = t.orders
    req = o.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") - 1).alias("cv_version_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(F.expr("o_orderkey * 4 div 15")).alias("job_posting_id"))
    return J.build_analysis_inputs(req, V.v_cv(t), V.v_applications(t))
