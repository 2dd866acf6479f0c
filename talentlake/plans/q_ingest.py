"""Registered queries for the A operators (sources, sinks, merges, reports)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentlake.functions.columns import remote_policy
from talentlake.operators import aggs
from talentlake.operators import merge as M
from talentlake.operators import reports as RP
from talentlake.plans import views as V
from talentlake.plans.oracle_views import with_views as W
from talentlake.plans.registry import register
from talentlake.sources import ingest as I
from talentlake.sources.tables import TABLES, Tables


# --------------------------------------------------------------------------- A2
def _guide_groups(t):
    """Knowledge 'files' built from parts: one file per ten consecutive part keys."""
    p = t.part.withColumn("grp", (F.col("p_partkey") / 10).cast("bigint"))
    return p.groupBy("grp")


def knowledge_inputs(t):
    g = _guide_groups(t)
    item = F.struct("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    rows = g.agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("p_type").alias("t"),
                 F.min("p_brand").alias("b"), F.min("p_name").alias("n"))
    fname = lambda kind: F.concat(F.lit(kind + "_"), F.col("grp").cast("string"), F.lit(".json"))
    bullets = rows.select(
        fname("bullets").alias("source_file"),
        F.when(F.col("grp") % 7 != 0, F.concat(F.lower("t"), F.lit("_specialist"))).alias("role_category"),
        F.transform("items", lambda x: F.struct(
            x["p_name"].alias("text"),
            F.when(x["p_size"] % 3 != 0, x["p_brand"]).alias("skill_area"),
            F.when(x["p_size"] % 2 != 0, F.lit("quantitative")).alias("impact_type"))).alias("bullets"))
    interviews = rows.select(
        fname("interviews").alias("source_file"),
        F.when(F.col("grp") % 5 != 0, F.lower("b")).alias("category"),
        F.transform("items", lambda x: F.struct(
            F.when(x["p_size"] % 6 != 0, x["p_type"]).alias("topic"),
            x["p_name"].alias("question"),
            F.when(x["p_size"] % 4 != 0, x["p_type"]).alias("what_theyre_testing"),
            F.when(x["p_size"] % 5 != 0, F.lit("Situation, task, action, result")).alias("good_answer_structure"),
        )).alias("questions"))
    guides = rows.select(
        fname("guides").alias("source_file"),
        F.col("t").alias("industry"),
        F.regexp_replace(F.lower("n"), " ", "_").alias("role"),
        F.array_sort(F.array_distinct(F.transform("items", lambda x: x["p_brand"]))).alias("must_have_keywords"),
        F.array_sort(F.array_distinct(F.transform("items", lambda x: x["p_type"]))).alias("nice_to_have_keywords"),
        F.transform("items", lambda x: x["p_name"]).alias("tips"))
    return bullets, interviews, guides


def _initcap_sql(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), "
            f"lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')")


KNOWLEDGE_SQL = f"""
WITH items AS (SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS grp, p_partkey, p_name, p_brand, p_type, p_size FROM part),
g AS (SELECT grp, min(p_type) AS t, min(p_brand) AS b, min(p_name) AS n FROM items GROUP BY grp),
ix AS (SELECT grp, p_partkey, p_name, p_brand, p_type, p_size,
         CAST(row_number() OVER (PARTITION BY grp ORDER BY p_partkey, p_name, p_brand, p_type, p_size) - 1 AS INT) AS pos
       FROM items),
bul AS (SELECT 'bullets_' || CAST(g.grp AS VARCHAR) || '.json' AS source_file, ix.pos, 'cv_bullet_template' AS type,
          coalesce(CASE WHEN g.grp % 7 <> 0 THEN lower(g.t) || '_specialist' END, 'general') AS category,
          ix.p_name AS btext, CASE WHEN ix.p_size % 3 <> 0 THEN ix.p_brand END AS skill_area,
          CASE WHEN ix.p_size % 2 <> 0 THEN 'quantitative' END AS impact
        FROM g JOIN ix ON g.grp = ix.grp),
itv AS (SELECT 'interviews_' || CAST(g.grp AS VARCHAR) || '.json' AS source_file, ix.pos,
          coalesce(CASE WHEN g.grp % 5 <> 0 THEN lower(g.b) END, 'general') AS category,
          CASE WHEN ix.p_size % 6 <> 0 THEN ix.p_type END AS topic, ix.p_name AS question,
          CASE WHEN ix.p_size % 4 <> 0 THEN ix.p_type END AS testing,
          CASE WHEN ix.p_size % 5 <> 0 THEN 'Situation, task, action, result' END AS structure
        FROM g JOIN ix ON g.grp = ix.grp),
gd AS (SELECT 'guides_' || CAST(grp AS VARCHAR) || '.json' AS source_file, t AS industry, replace(lower(n), ' ', '_') AS role,
         (SELECT list_sort(list_distinct(list(p_brand))) FROM items i WHERE i.grp = g.grp) AS must,
         (SELECT list_sort(list_distinct(list(p_type))) FROM items i WHERE i.grp = g.grp) AS nice,
         (SELECT list(p_name ORDER BY p_partkey, p_name, p_brand, p_type, p_size) FROM items i WHERE i.grp = g.grp) AS tips
       FROM g)
SELECT source_file, pos, type,
  'CV bullet example for ' || {_initcap_sql("category")} || ': ' || btext AS text,
  category, coalesce(skill_area, 'general') AS subcategory, coalesce(impact, 'qualitative') AS impact_type FROM bul
UNION ALL
SELECT source_file, pos, 'interview_question',
  'Interview question (' || category || '): ' || question || '. What they''re testing: ' || coalesce(testing, 'Various skills')
    || '. Good answer structure: ' || coalesce(structure, 'Use STAR method.'),
  category, coalesce(topic, 'general'), CAST(NULL AS VARCHAR) FROM itv
UNION ALL
SELECT source_file, 0, 'ats_keyword_guide',
  'ATS keyword guide for ' || {_initcap_sql("coalesce(role, 'general')")} || ' in ' || coalesce(industry, 'general')
    || '. Must-have keywords: ' || array_to_string(must, ', ') || '. Nice-to-have keywords: ' || array_to_string(nice, ', ')
    || '. Tips: ' || array_to_string(tips, ' '),
  coalesce(role, 'general'), coalesce(industry, 'general'), CAST(NULL AS VARCHAR) FROM gd"""


@register("knowledge_docs", KNOWLEDGE_SQL)
def q_knowledge_docs(spark, d):
    b, i, g = knowledge_inputs(Tables(spark, d))
    return I.knowledge_docs(b, i, g)


# --------------------------------------------------------------------------- A3 / A4
@register("doc_admission", """
SELECT doc_id, kind, reason IS NULL AS admitted, reason AS reject_reason FROM (
  SELECT doc_id, k.kind, CASE WHEN text IS NULL THEN 'missing' WHEN length(trim(text)) < k.min_len THEN 'too_short' END AS reason
  FROM documents, (VALUES ('posting', 50), ('cv_upload', 100)) k(kind, min_len))""")
def q_doc_admission(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text")
    a = I.admit_documents(docs, "text", 50, "posting")
    b = I.admit_documents(docs, "text", 100, "cv_upload")
    return a.unionByName(b).select("doc_id", "kind", "admitted", "reject_reason")


@register("file_admission", """
SELECT page_id, reason IS NULL AS admitted, reason AS reject_reason FROM (
  SELECT page_id, CASE WHEN octet_length(encode(html)) > 5242880 THEN 'too_large'
                       WHEN NOT starts_with(html, '%PDF') THEN 'not_pdf'
                       WHEN octet_length(encode(html)) < 100 THEN 'too_small' END AS reason FROM (
    SELECT page_id, CASE page_id % 25 WHEN 0 THEN repeat('%PDF-1.7 ' || html, 5242880 // length(html) + 1)
      WHEN 1 THEN '%PDF tiny ' || page_id WHEN 2 THEN '%PDF-1.4 ' || html || repeat(' ', 100) ELSE html END AS html FROM pages))""")
def q_file_admission(spark, d):
    """Some pages as files: too large, too small, a right one, and no PDF."""
    n, html = F.col("page_id") % 25, F.col("html")
    content = (F.when(n == 0, F.repeat(F.concat(F.lit("%PDF-1.7 "), html), (F.floor(F.lit(5242880) / F.length(html)) + 1).cast("int")))
               .when(n == 1, F.concat(F.lit("%PDF tiny "), F.col("page_id").cast("string")))
               .when(n == 2, F.concat(F.lit("%PDF-1.4 "), html, F.repeat(F.lit(" "), 100))).otherwise(html))
    pg = Tables(spark, d).pages.select("page_id", content.alias("html"))
    files = pg.select("page_id", F.encode("html", "UTF-8").alias("content"),
                      F.octet_length("html").cast("long").alias("length"))
    return I.admit_files(files).select("page_id", "admitted", "reject_reason")


# --------------------------------------------------------------------------- A5
def _upsert_inputs(t):
    p = V.v_postings(t)
    t0 = p.select("id", "source", "source_job_id",
                  F.concat(F.lit("https://jobs.example/"), F.col("id").cast("string")).alias("source_url"),
                  "company_name", "role_title", "location", remote_policy("policy_text").alias("remote_policy"),
                  "salary_min", "salary_max", F.lit(None).cast("string").alias("description_text"),
                  F.lit(None).cast("string").alias("requirements_text"), "is_active",
                  F.col("discovered_at").alias("updated_at"))
    target = t0.groupBy("source", "source_job_id").agg(
        F.min_by(F.struct(*[c for c in t0.columns if c not in ("source", "source_job_id")]), F.col("id")).alias("_r")
    ).select("source", "source_job_id", "_r.*").select(*t0.columns)
    pt = t.part
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
    return target, M.normalise_posting(up)


UPSERT_SQL = W(["v_postings"], """
SELECT coalesce(t.id, f.id) AS id, k.source, k.source_job_id,
  CASE WHEN t.in_t THEN t.source_url ELSE f.source_url END AS source_url,
  CASE WHEN l.source IS NOT NULL THEN l.company_name ELSE t.company_name END AS company_name,
  CASE WHEN l.source IS NOT NULL THEN l.role_title ELSE t.role_title END AS role_title,
  CASE WHEN l.source IS NOT NULL THEN l.location ELSE t.location END AS location,
  CASE WHEN t.in_t THEN t.remote_policy ELSE f.remote_policy END AS remote_policy,
  CASE WHEN l.source IS NOT NULL THEN l.salary_min ELSE t.salary_min END AS salary_min,
  CASE WHEN l.source IS NOT NULL THEN l.salary_max ELSE t.salary_max END AS salary_max,
  CASE WHEN l.source IS NOT NULL THEN l.description_text ELSE t.description_text END AS description_text,
  CASE WHEN l.source IS NOT NULL THEN l.requirements_text ELSE t.requirements_text END AS requirements_text,
  CASE WHEN l.source IS NOT NULL THEN true ELSE t.is_active END AS is_active,
  CASE WHEN l.source IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE t.updated_at END AS updated_at
FROM (SELECT source, source_job_id FROM target UNION SELECT source, source_job_id FROM u) k
LEFT JOIN (SELECT *, true AS in_t FROM target) t ON t.source = k.source AND t.source_job_id = k.source_job_id
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_job_id ORDER BY arrival) AS rn FROM u)
           WHERE rn = 1) f ON f.source = k.source AND f.source_job_id = k.source_job_id
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_job_id ORDER BY arrival DESC) AS rn FROM u)
           WHERE rn = 1) l ON l.source = k.source AND l.source_job_id = k.source_job_id""", extra=[
    ("t0", """SELECT id, source, source_job_id, 'https://jobs.example/' || CAST(id AS VARCHAR) AS source_url, company_name,
              role_title, location,
              CASE WHEN lower(policy_text) LIKE '%remote%' AND lower(policy_text) NOT LIKE '%hybrid%' THEN 'remote'
                   WHEN lower(policy_text) LIKE '%hybrid%' THEN 'hybrid'
                   WHEN regexp_matches(lower(policy_text), 'on-site|onsite|in-office') THEN 'onsite' ELSE '' END AS remote_policy,
              salary_min, salary_max, CAST(NULL AS VARCHAR) AS description_text, CAST(NULL AS VARCHAR) AS requirements_text,
              is_active, discovered_at AS updated_at FROM v_postings"""),
    ("target", """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, source_job_id ORDER BY id) AS rn
                  FROM t0) WHERE rn = 1"""),
    ("u", """SELECT p_partkey + 100000 AS id, lower(CASE WHEN p_partkey % 2 = 0 THEN 'INDEED' ELSE 'GLASSDOOR' END) AS source,
             coalesce(CASE WHEN p_size <> 1 THEN 'jk' || CAST(p_partkey * 9 // 10 AS VARCHAR) END, CAST(p_partkey + 100000 AS VARCHAR))
               AS source_job_id,
             'https://new.example/' || CAST(p_partkey AS VARCHAR) AS source_url, p_brand || ' Inc' AS company_name,
             p_name AS role_title, nullif(CASE WHEN p_size % 4 <> 0 THEN p_type ELSE '' END, '') AS location,
             'remote' AS remote_policy, CASE WHEN p_size * 1000 > 0 THEN p_size * 1000 END AS salary_min,
             CASE WHEN (CASE WHEN p_size % 5 <> 0 THEN p_size * 1500 ELSE 0 END) > 0 THEN p_size * 1500 END AS salary_max,
             p_name || ' at ' || p_brand AS description_text,
             nullif(CASE WHEN p_size % 3 <> 0 THEN p_type ELSE '' END, '') AS requirements_text, p_partkey AS arrival
             FROM part"""),
])


@register("merge_upsert", UPSERT_SQL)
def q_merge_upsert(spark, d):
    target, updates = _upsert_inputs(Tables(spark, d))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return M.merge_upsert(target, updates, ["source", "source_job_id"], M.UPSERT_SET_COLS, "arrival", now)


# --------------------------------------------------------------------------- A6
FINDINGS_IN_SQL = """
SELECT doc_id AS id, source AS topic,
  CASE lang WHEN 'en' THEN 'role_trend' WHEN 'fr' THEN 'skill_demand' WHEN 'de' THEN 'salary_insight' ELSE 'other' END AS category,
  CAST(n_chars % 150 - 20 AS INT) AS relevance_score,
  CASE WHEN doc_id % 3 = 0 THEN '{"src": "' || source || '"}' WHEN doc_id % 3 = 1 THEN 'not json' END AS metadata,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'https://news.example/' || CAST(doc_id AS VARCHAR) END AS source_url
FROM documents"""


def _findings_in(t):
    dd = t.documents
    return dd.select(
        F.col("doc_id").alias("id"), F.col("source").alias("topic"),
        F.when(F.col("lang") == "en", "role_trend").when(F.col("lang") == "fr", "skill_demand")
        .when(F.col("lang") == "de", "salary_insight").otherwise("other").alias("category"),
        (F.col("n_chars") % 150 - 20).cast("int").alias("relevance_score"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"src": "'), F.col("source"), F.lit('"}')))
        .when(F.col("doc_id") % 3 == 1, F.lit("not json")).alias("metadata"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("")).otherwise(
            F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string"))).alias("source_url"))


@register("findings_append", W([], """
SELECT id, topic, category, least(greatest(relevance_score, 0), 100) AS relevance_score,
  CASE WHEN json_valid(metadata) THEN metadata ELSE '{}' END AS metadata, nullif(source_url, '') AS source_url
FROM f WHERE category IN ('skill_demand', 'salary_insight', 'role_trend', 'industry_news')""",
    extra=[("f", FINDINGS_IN_SQL)]))
def q_findings_append(spark, d):
    return M.append_findings(_findings_in(Tables(spark, d)))[0]


@register("findings_rejected", W([], """
SELECT *, 'invalid category: ' || coalesce(category, 'null') AS reject_reason
FROM f WHERE category NOT IN ('skill_demand', 'salary_insight', 'role_trend', 'industry_news') OR category IS NULL""",
    extra=[("f", FINDINGS_IN_SQL)]))
def q_findings_rejected(spark, d):
    return M.append_findings(_findings_in(Tables(spark, d)))[1]


# --------------------------------------------------------------------------- A7
CASCADE_EDGES = [
    ("region", "r_regionkey", "nation", "n_regionkey", "cascade"),
    ("nation", "n_nationkey", "customer", "c_nationkey", "cascade"),
    ("nation", "n_nationkey", "supplier", "s_nationkey", "set_null"),
    ("customer", "c_custkey", "orders", "o_custkey", "cascade"),
]


@register("cascade_delete", """
WITH r AS (SELECT * FROM region WHERE r_name <> 'AFRICA'),
n AS (SELECT * FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'AFRICA')),
gone_n AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'AFRICA')),
c AS (SELECT * FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM gone_n)),
o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM gone_n)))
SELECT 'customer' AS table_name, count(*) AS "rows" FROM c
UNION ALL SELECT 'nation', count(*) FROM n
UNION ALL SELECT 'orders', count(*) FROM o
UNION ALL SELECT 'region', count(*) FROM r
UNION ALL SELECT 'supplier', count(*) FROM supplier
UNION ALL SELECT 'supplier_nulled', count(*) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM gone_n)""")
def q_cascade_delete(spark, d):
    t = Tables(spark, d)
    tables = {"region": t.region, "nation": t.nation, "customer": t.customer, "supplier": t.supplier, "orders": t.orders}
    ids = t.region.where(F.col("r_name") == "AFRICA").select("r_regionkey")
    out = M.cascade_delete(tables, CASCADE_EDGES, "region", "r_regionkey", ids)
    inv = RP.table_inventory(out)
    nulled = out["supplier"].join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("_old")), "s_suppkey") \
        .where(F.col("s_nationkey").isNull() & F.col("_old").isNotNull()) \
        .agg(F.count(F.lit(1)).alias("rows")).select(F.lit("supplier_nulled").alias("table_name"), "rows")
    return inv.unionByName(nulled)


@register("cascade_delete_owned", """
WITH asked AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey ELSE o_custkey + 1 END AS who FROM orders WHERE o_orderkey % 5 = 0),
gone AS (SELECT o_orderkey FROM orders JOIN asked ON o_orderkey = k AND o_custkey = who)
SELECT 'orders' AS table_name, o_orderkey AS key, o_custkey AS parent, CAST(NULL AS INT) AS line FROM orders WHERE o_orderkey NOT IN (FROM gone)
UNION ALL SELECT 'lineitem', l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (FROM gone)""")
def q_cascade_delete_owned(spark, d):
    """All rows that are left when customers delete orders, half of which are not theirs."""
    t = Tables(spark, d)
    o, li = t.orders, t.lineitem
    key = F.col("o_orderkey")
    asked = o.where(key % 5 == 0).select(key.alias("k"), F.when(key % 10 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("who"))
    out = M.cascade_delete({"orders": o, "lineitem": li}, [("orders", "o_orderkey", "lineitem", "l_orderkey", "cascade")], "orders",
                           "o_orderkey", asked, owner="o_custkey")
    left = out["orders"].select(F.lit("orders").alias("table_name"), key.alias("key"), F.col("o_custkey").alias("parent"),
                                F.lit(None).cast("int").alias("line"))
    return left.unionByName(out["lineitem"].select(F.lit("lineitem").alias("table_name"), F.col("l_orderkey").alias("key"),
                                                   F.col("l_partkey").alias("parent"), F.col("l_linenumber").alias("line")))


# --------------------------------------------------------------------------- A8
CHARTS = [("status_breakdown", "Current Status Distribution", "donut", "Where applications stand today"),
          ("skill_gaps", "Most Common Missing Skills", "horizontalBar", "Skills most often missing"),
          ("fit_scores", "Fit Score Distribution", "bar", "How well candidates match"),
          ("bad_chart", "Not allowed", "radar", "Dropped: type outside the allowed six")]


@register("chart_json", W(["v_applications", "v_gaps", "v_analyses"], """
SELECT c.key, CAST(to_json({'key': c.key, 'title': c.title, 'type': c.type, 'description': c.description,
  'data': coalesce(d.data, [])}) AS VARCHAR) AS chart
FROM (VALUES """ + ", ".join("('%s', '%s', '%s', '%s')" % c for c in CHARTS) + """) c(key, title, type, description)
LEFT JOIN (SELECT key, list({'name': name, 'value': value,
    'color': ['#3B82F6', '#10B981', '#F59E0B', '#EF4444', '#6366F1', '#8B5CF6', '#A855F7', '#6B7280'][((rank - 1) % 8) + 1]}
    ORDER BY rank) AS data FROM pts GROUP BY key) d ON c.key = d.key
WHERE c.type IN ('pie', 'bar', 'donut', 'horizontalBar', 'funnel', 'line')""", extra=[("pts", """
SELECT 'status_breakdown' AS key, status AS name, n AS value, row_number() OVER (ORDER BY n DESC, status) AS rank
  FROM (SELECT status, count(*) AS n FROM v_applications GROUP BY status)
UNION ALL SELECT 'skill_gaps', skill, n, row_number() OVER (ORDER BY n DESC, skill) FROM (
  SELECT coalesce(missing_element, requirement, 'Unknown') AS skill, count(*) AS n FROM v_gaps GROUP BY 1
  ORDER BY n DESC, skill LIMIT 5)
UNION ALL SELECT 'fit_scores', band, n, band_order + 1 FROM (
  SELECT b.band_order, b.band, coalesce(c.n, 0) AS n
  FROM (VALUES (0, '90-100'), (1, '75-89'), (2, '60-74'), (3, 'Below 60')) b(band_order, band)
  LEFT JOIN (SELECT CASE WHEN fit_score >= 90 THEN '90-100' WHEN fit_score >= 75 THEN '75-89' WHEN fit_score >= 60 THEN '60-74'
             ELSE 'Below 60' END AS band, count(*) AS n FROM v_analyses WHERE fit_score IS NOT NULL GROUP BY 1) c
  ON b.band = c.band)""")]))
def q_chart_json(spark, d):
    t = Tables(spark, d)
    apps, gaps, an = V.v_applications(t), V.v_gaps(t), V.v_analyses(t)
    status = apps.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    p1 = RP.ranked_points(status, "status_breakdown", "status", "n")
    top = aggs.gap_frequency(gaps, k=5)
    p2 = RP.ranked_points(top, "skill_gaps", "skill", "count")
    bands = aggs.fit_bands(an, scheme="chart")
    p3 = bands.select(F.lit("fit_scores").alias("key"), F.col("band").alias("name"), F.col("count").alias("value"),
                      (F.col("band_order") + 1).alias("rank"))
    charts = spark.createDataFrame(CHARTS, "key STRING, title STRING, type STRING, description STRING")
    return RP.chart_json(p1.unionByName(p2).unionByName(p3), charts)


# --------------------------------------------------------------------------- A9
@register("table_inventory", "\nUNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS \"rows\" FROM {n}" for n in sorted(TABLES)))
def q_table_inventory(spark, d):
    t = Tables(spark, d)
    return RP.table_inventory({n: getattr(t, n) for n in TABLES})


# --------------------------------------------------------------------------- A10
@register("apply_patches", W(["v_cv"], """
SELECT c.id, c.user_id, coalesce(pv.v, c.version_name) AS version_name, coalesce(pp.v, c.is_primary) AS is_primary, c.created_at
FROM v_cv c
LEFT JOIN (SELECT id, v FROM (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY ord DESC, v DESC) AS rn
           FROM (SELECT l_orderkey AS id, l_linenumber AS ord,
                   CASE WHEN l_linenumber % 2 = 0 THEN 'v' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) END AS v
                 FROM lineitem) WHERE v IS NOT NULL) WHERE rn = 1) pv ON pv.id = c.id
LEFT JOIN (SELECT id, v FROM (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY ord DESC, v DESC) AS rn
           FROM (SELECT l_orderkey AS id, l_linenumber AS ord,
                   CASE WHEN l_returnflag = 'R' THEN l_linestatus = 'O' END AS v FROM lineitem) WHERE v IS NOT NULL)
           WHERE rn = 1) pp ON pp.id = c.id"""))
def q_apply_patches(spark, d):
    t = Tables(spark, d)
    li = t.lineitem
    patches = li.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("v"), F.col("l_linenumber").cast("string"), F.lit("-"),
                                                         F.col("l_partkey").cast("string"))).alias("version_name"),
        F.when(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O").alias("is_primary"),
        F.col("l_suppkey").alias("user_id"))
    return M.apply_patches(V.v_cv(t), patches, "id", ["version_name", "is_primary"], "ord")


# --------------------------------------------------------------------------- A11
@register("insert_if_absent", """
WITH users AS (SELECT 'user_' || CAST(c_custkey * 2 AS VARCHAR) AS clerk_user_id, c_name AS name,
                 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email, [c_mktsegment] AS target_roles
               FROM customer),
signups AS (SELECT 'user_' || CAST(o_custkey AS VARCHAR) AS clerk_user_id,
              CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '' ELSE 'Name ' || CAST(o_orderkey AS VARCHAR) END
                AS token_name,
              CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'u' || CAST(o_custkey AS VARCHAR) || '@example.com' END AS email,
              o_orderkey AS arrival FROM orders)
SELECT clerk_user_id, name, email, target_roles FROM users
UNION ALL
SELECT clerk_user_id, coalesce(nullif(trim(token_name), ''), nullif(split_part(email, '@', 1), ''), 'New User'), email,
  []::VARCHAR[] FROM (
  SELECT *, row_number() OVER (PARTITION BY clerk_user_id ORDER BY arrival) AS rn FROM signups s
  WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.clerk_user_id = s.clerk_user_id)) WHERE rn = 1""")
def q_insert_if_absent(spark, d):
    t = Tables(spark, d)
    c, o = t.customer, t.orders
    users = c.select(  # every second customer number is taken
        F.concat(F.lit("user_"), (F.col("c_custkey") * 2).cast("string")).alias("clerk_user_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.array("c_mktsegment").alias("target_roles"))
    k = F.col("o_orderkey") % 3
    signups = o.select(
        F.concat(F.lit("user_"), F.col("o_custkey").cast("string")).alias("clerk_user_id"),
        F.when(k == 1, F.lit("")).when(k == 2, F.concat(F.lit("Name "), F.col("o_orderkey").cast("string"))).alias("token_name"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("@example.com")))
        .alias("email"),
        F.col("o_orderkey").alias("arrival"))
    return M.insert_if_absent(users, signups, "clerk_user_id", "arrival", default_arrays=["target_roles"])


# --------------------------------------------------------------------------- A12
@register("route_batch", """
SELECT conv_id AS message_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, type,
  CASE WHEN type IN ('cv', 'job') AND coalesce(trim(text), '') <> '' THEN type END AS route,
  CASE WHEN type NOT IN ('cv', 'job') OR type IS NULL THEN 'unknown type: ' || coalesce(type, 'null')
       WHEN coalesce(trim(text), '') = '' THEN 'empty text' END AS error, text
FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'cv' WHEN 'assistant' THEN 'job' ELSE role END AS type, text
      FROM conversations)""")
def q_route_batch(spark, d):
    cv = Tables(spark, d).conversations
    typ = F.when(F.col("role") == "user", "cv").when(F.col("role") == "assistant", "job").otherwise(F.col("role"))
    # one batch message per conversation (a conversation has few turns: bounded collect)
    msgs = cv.groupBy(F.col("conv_id").alias("message_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", typ.alias("type"), "text"))).alias("_items")).select(
        "message_id", F.to_json(F.struct(F.transform("_items", lambda x: F.struct(x["type"].alias("type"),
                                                                                    x["text"].alias("text"))).alias("batch"))).alias("body"))
    return I.route_batch(msgs)


@register("cv_text_profile", """
SELECT count(*) AS "rows", CAST(count_if(parsed IS NOT NULL) AS BIGINT) AS parsed, CAST(min(length(text)) AS INT) AS min_len,
  round(avg(length(text)), 2) AS avg_len, CAST(max(length(text)) AS INT) AS max_len
FROM (SELECT d.text, l.quality AS parsed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def q_cv_text_profile(spark, d):
    t = Tables(spark, d)
    docs = t.documents.join(t.labels.select("doc_id", F.col("quality").alias("parsed")), "doc_id", "left")
    return RP.text_profile(docs, "text", "parsed")
