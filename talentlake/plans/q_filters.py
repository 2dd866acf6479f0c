"""Registered queries for the B operators (projections, filters, checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentlake.operators import filters as B
from talentlake.plans import views as V
from talentlake.plans.oracle_views import with_views as W
from talentlake.plans.registry import register
from talentlake.sources.tables import Tables


@register("text_preview", """
SELECT doc_id, left(text, 200) AS preview_cv, left(text, 300) AS preview_posting, left(text, 500) AS preview_discovered
FROM documents""")
def q_text_preview(spark, d):
    docs = Tables(spark, d).documents
    return docs.select("doc_id", B.preview("text", 200).alias("preview_cv"),
                       B.preview("text", 300).alias("preview_posting"),
                       B.preview("text", 500).alias("preview_discovered"))


@register("feed_filter", W(["v_postings"], """
SELECT * FROM v_postings WHERE is_active AND lower(source) = 'indeed' AND location = 'NATION_3'"""))
def q_feed_filter(spark, d):
    return B.filter_feed(V.v_postings(Tables(spark, d)), source="Indeed", location="NATION_3", company_name="")


@register("location_search", r"""
SELECT * FROM nation WHERE n_name ILIKE '%tion\_1%' ESCAPE '\'""")
def q_location_search(spark, d):
    return B.contains_ci(Tables(spark, d).nation, "n_name", "tion_1")


@register("part_search", """
SELECT * FROM part WHERE p_name ILIKE '%BOLT%'""")
def q_part_search(spark, d):
    return B.contains_ci(Tables(spark, d).part, "p_name", "BOLT")


LOOKUP_REQ = """SELECT id, cv_version_id AS user_id FROM v_analyses
                UNION ALL SELECT job_id AS id, cv_version_id AS user_id FROM v_analyses"""


@register("batch_lookup", W(["v_cv", "v_analyses"], """
SELECT * FROM v_cv c WHERE EXISTS (SELECT 1 FROM req r WHERE r.id = c.id AND r.user_id = c.user_id)""",
    extra=[("req", LOOKUP_REQ)]))
def q_batch_lookup(spark, d):
    t = Tables(spark, d)
    ga = V.v_analyses(t)
    req = ga.select("id", F.col("cv_version_id").alias("user_id")).unionByName(
        ga.select(F.col("job_id").alias("id"), F.col("cv_version_id").alias("user_id")))
    return B.lookup(V.v_cv(t), req)


@register("normalise_blanks", W(["v_postings"], """
SELECT id, lower(source) AS source, source_job_id, role_title,
  coalesce(nullif(trim(company_name), ''), 'Unknown') AS company_name, location,
  nullif(trim(policy_text), '') AS policy_text, salary_min, CASE WHEN salary_max > 0 THEN salary_max END AS salary_max,
  is_active, discovered_at FROM v_postings"""))
def q_normalise_blanks(spark, d):
    return B.normalise_blanks(V.v_postings(Tables(spark, d)), blank_to_null=("policy_text",), positive=("salary_max",),
                              lower=("source",), defaults={"company_name": "Unknown"})


DOC_CONTRACT = {
    "lang": {"enum": ["en", "fr", "de"], "not_null": True},
    "n_chars": {"range": (50, 20000)},
    "source": {"max_len": 4},
    "text": {"not_null": True},
}


@register("contract_violations", """
SELECT doc_id AS row_id, 'lang' AS "column", 'not_null' AS rule, lang AS value FROM documents WHERE lang IS NULL
UNION ALL SELECT doc_id, 'lang', 'enum', lang FROM documents WHERE lang IS NOT NULL AND lang NOT IN ('en', 'fr', 'de')
UNION ALL SELECT doc_id, 'n_chars', 'range', CAST(n_chars AS VARCHAR) FROM documents
  WHERE n_chars IS NOT NULL AND (n_chars < 50 OR n_chars > 20000)
UNION ALL SELECT doc_id, 'source', 'max_len', source FROM documents WHERE length(source) > 4
UNION ALL SELECT doc_id, 'text', 'not_null', text FROM documents WHERE text IS NULL""")
def q_contract_violations(spark, d):
    return B.contract_violations(Tables(spark, d).documents, "doc_id", DOC_CONTRACT)


@register("event_props", """
SELECT event_id, props, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def q_event_props(spark, d):
    ev = Tables(spark, d).events.select("event_id", "props")
    return B.parse_payload(ev, "props", "k BIGINT").select("event_id", "props", F.col("parsed.k").alias("k"))


@register("weights_check", """
SELECT l_orderkey AS id, sum(l_quantity) AS weight_sum, abs(sum(l_quantity) - 100) <= 1e-9 AS weights_ok
FROM lineitem GROUP BY l_orderkey""")
def q_weights_check(spark, d):
    li = Tables(spark, d).lineitem
    # allocation map per order: position → quantity (an order's lines are few: bounded collect)
    w = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_quantity").alias("_q")).select(
        "id", F.map_from_arrays(F.sequence(F.lit(1), F.size("_q")), F.col("_q")).alias("weights"))
    return B.weights_sum_check(w, "weights", 100.0).select("id", "weight_sum", "weights_ok")


COMPOSE_IN = """SELECT id, role_title, company_name, location,
  CASE WHEN id % 3 = 0 THEN NULL ELSE role_title || ' role in ' || location END AS description_text,
  CASE WHEN id % 4 = 0 THEN NULL ELSE company_name END AS requirements_text FROM v_postings"""


@register("compose_posting", W(["v_postings"], """
SELECT id, CASE WHEN length(body) < 50
  THEN 'Job: ' || coalesce(role_title, 'None') || ' at ' || coalesce(company_name, 'None') || chr(10) || chr(10)
       || 'Location: ' || coalesce(nullif(location, ''), 'Not specified')
  ELSE body END AS raw_text
FROM (SELECT *, CASE WHEN requirements_text IS NOT NULL AND requirements_text <> ''
        THEN coalesce(description_text, '') || chr(10) || chr(10) || 'Requirements:' || chr(10) || requirements_text
        ELSE coalesce(description_text, '') END AS body FROM inp)""", extra=[("inp", COMPOSE_IN)]))
def q_compose_posting(spark, d):
    p = V.v_postings(Tables(spark, d))
    inp = p.select("id", "role_title", "company_name", "location",
                   F.when(F.col("id") % 3 != 0, F.concat_ws(" role in ", "role_title", "location")).alias("description_text"),
                   F.when(F.col("id") % 4 != 0, F.col("company_name")).alias("requirements_text"))
    return inp.select("id", B.compose_text().alias("raw_text"))


@register("truncate_payload", """
SELECT doc_id, CASE WHEN length(text) > 2000
  THEN left(text, 2000) || '... [truncated, total ' || CAST(length(text) AS VARCHAR) || ' chars]' ELSE text END AS text
FROM documents""")
def q_truncate_payload(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", "text")
    return B.truncate_payload(docs, ["text"], n=2000)


@register("truncate_nested", """
SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '... [truncated, total ' || length(text) || ' chars]' ELSE text END AS body,
  least(len(string_split(text, ' ')), 4) AS n_words, CASE WHEN length(lang || text) > 300
    THEN left(lang || text, 300) || '... [truncated, total ' || length(lang || text) || ' chars]' ELSE lang || text END AS tagged
FROM documents""")
def q_truncate_nested(spark, d):
    """A struct with a string, an array of structs and a map, capped at every depth."""
    docs = Tables(spark, d).documents
    parts = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("w")))
    payload = F.struct(F.col("text").alias("body"), parts.alias("words"), F.create_map(F.lit("tagged"), F.concat("lang", "text")).alias("more"))
    cut = B.truncate_payload(docs.select("doc_id", payload.alias("payload")), ["payload"], n=300, items=4)
    return cut.select("doc_id", "payload.body", F.size("payload.words").cast("long").alias("n_words"), F.col("payload.more")["tagged"].alias("tagged"))


@register("payload_keys", """
SELECT "column", key, count(*) AS count FROM (
  SELECT 'props' AS "column", unnest(json_keys(props)) AS key FROM events
  UNION ALL SELECT 'detail', unnest(json_keys('{"type": 1, "' || event_type || '": 2}')) FROM events) GROUP BY ALL""")
def q_payload_keys(spark, d):
    e = Tables(spark, d).events
    detail = F.concat(F.lit('{"type": 1, "'), F.col("event_type"), F.lit('": 2}'))
    return B.payload_keys(e.select("props", detail.alias("detail")), ["props", "detail"])


@register("payload_profile", """
SELECT "column", count(value) AS present, CAST(min(length(value)) AS INT) AS min_len,
  round(avg(length(value)), 2) AS avg_len, CAST(max(length(value)) AS INT) AS max_len,
  CAST(count_if(trim(value) LIKE '{%' AND json_valid(value)) AS BIGINT) AS json_objects,
  CAST(count_if(trim(value) LIKE '[%' AND json_valid(value)) AS BIGINT) AS json_arrays,
  CAST(max(CASE WHEN trim(value) LIKE '{%' AND json_valid(value) THEN len(json_keys(value)) END) AS INT) AS max_keys,
  CAST(max(CASE WHEN trim(value) LIKE '[%' AND json_valid(value) THEN json_array_length(value) END) AS INT) AS max_items
FROM (SELECT 'props' AS "column", props AS value FROM events UNION ALL SELECT 'event_type', event_type FROM events)
GROUP BY "column"
""")
def q_payload_profile(spark, d):
    return B.payload_profile(Tables(spark, d).events, ["props", "event_type"])


@register("event_props_variant", """
SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CAST(json_type(props) AS VARCHAR) = 'OBJECT' AS is_object FROM events""")
def q_event_props_variant(spark, d):
    ev = Tables(spark, d).events.select("event_id", "props")
    v = B.parse_payload_variant(ev, "props")
    return v.select("event_id", F.variant_get("parsed", "$.k", "bigint").alias("k"),
                    (F.schema_of_variant("parsed").startswith("OBJECT")).alias("is_object"))
