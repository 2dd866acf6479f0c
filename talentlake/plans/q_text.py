"""Registered queries for the T operators (text, JSON, date and salary jobs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentlake.functions import columns as C
from talentlake.functions import text as T
from talentlake.operators.common import words
from talentlake.plans import views as V
from talentlake.plans.oracle_views import with_views as W
from talentlake.plans.q_joins import q_match_requirements
from talentlake.plans.registry import ORACLES, register
from talentlake.sources.tables import Tables

WORDS_RE = r"[^\p{L}\p{N}]+"

SALARY_SQL = r"""
SELECT id, salary_text,
  CASE WHEN len(v) > 0 THEN list_min(v) ELSE 0 END AS salary_min,
  CASE WHEN len(v) > 0 THEN list_max(v) ELSE 0 END AS salary_max
FROM (SELECT id, salary_text, list_filter(list_transform(regexp_extract_all(salary_text, '\$?[0-9,]+\.?[0-9]*[kK]?'),
    lambda m: CAST(floor(CASE WHEN TRY_CAST(regexp_replace(m, '[^0-9.]', '', 'g') AS DOUBLE) < 1000 AND {k}
                         THEN TRY_CAST(regexp_replace(m, '[^0-9.]', '', 'g') AS DOUBLE) * 1000
                         ELSE TRY_CAST(regexp_replace(m, '[^0-9.]', '', 'g') AS DOUBLE) END) AS BIGINT)),
    lambda x: x IS NOT NULL) AS v FROM v_salary)"""


@register("parse_salary", W(["v_salary"], SALARY_SQL.format(k="lower(m) LIKE '%k'")))
def q_parse_salary(spark, d):
    s = V.v_salary(Tables(spark, d))
    return s.select("id", "salary_text", C.parse_salary("salary_text").alias("_s")).select("id", "salary_text", "_s.*")


@register("parse_salary_strict", W(["v_salary"], SALARY_SQL.format(k="lower(salary_text) LIKE '%k%'")))
def q_parse_salary_strict(spark, d):
    s = V.v_salary(Tables(spark, d))
    return s.select("id", "salary_text", C.parse_salary("salary_text", strict_ref=True).alias("_s")).select(
        "id", "salary_text", "_s.*")


@register("remote_policy", W(["v_postings"], """
SELECT id, policy_text,
  CASE WHEN lower(concat_ws(' ', role_title, policy_text)) LIKE '%remote%'
         AND lower(concat_ws(' ', role_title, policy_text)) NOT LIKE '%hybrid%' THEN 'remote'
       WHEN lower(concat_ws(' ', role_title, policy_text)) LIKE '%hybrid%' THEN 'hybrid'
       WHEN regexp_matches(lower(concat_ws(' ', role_title, policy_text)), 'on-site|onsite|in-office') THEN 'onsite'
       ELSE '' END AS remote_policy FROM v_postings"""))
def q_remote_policy(spark, d):
    p = V.v_postings(Tables(spark, d))
    return p.select("id", "policy_text", C.remote_policy("role_title", "policy_text").alias("remote_policy"))


@register("page_ids", r"""
SELECT page_id, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), '') AS host,
  regexp_extract(url, 'jk=([a-f0-9]+)', 1) AS job_key,
  CASE WHEN regexp_extract(url, 'jk=([a-f0-9]+)', 1) <> ''
       THEN 'https://www.indeed.com/viewjob?jk=' || regexp_extract(url, 'jk=([a-f0-9]+)', 1) ELSE '' END AS view_url,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '&jk=' || lower(to_hex(page_id)) ELSE url END AS url FROM pages)""")
def q_page_ids(spark, d):
    """Every third address carries a job key."""
    pg = Tables(spark, d).pages.withColumn("url", F.when(F.col("page_id") % 3 == 0, F.concat(
        "url", F.lit("&jk="), F.lower(F.hex("page_id")))).otherwise(F.col("url")))
    jk = C.external_id("url")
    return pg.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), jk.alias("job_key"),
                     C.canonical_url(jk).alias("view_url"),
                     F.try_parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"))


@register("contact_fields", f"""
SELECT doc_id, nullif(regexp_extract(text, '{T.EMAIL_RE}', 0), '') AS email,
  nullif(regexp_extract(text, '{T.PHONE_RE}', 0), '') AS phone,
  nullif(regexp_extract(text, '{T.LINKEDIN_RE}', 0), '') AS linkedin_url,
  nullif(regexp_extract(text, '{T.GITHUB_RE}', 0), '') AS github_url
FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' linkedin.com/in/p-' || doc_id WHEN doc_id % 3 = 1
        THEN ' https://github.com/u_' || doc_id || '/repo' ELSE '' END AS text FROM documents)""")
def q_contact_fields(spark, d):
    i = F.col("doc_id")
    link = (F.when(i % 3 == 0, F.concat(F.lit(" linkedin.com/in/p-"), i.cast("string")))
            .when(i % 3 == 1, F.concat(F.lit(" https://github.com/u_"), i.cast("string"), F.lit("/repo"))).otherwise(""))
    docs = Tables(spark, d).documents.select("doc_id", F.concat("text", link).alias("text"))
    return T.contact_fields(docs).drop("text")


SECTIONED_SQL = """SELECT doc_id, 'Must have:' || chr(10) || '====' || chr(10) || '- 3+ years ' || lang || chr(10) || '- '
  || replace(text, chr(10), chr(10) || '- ') || chr(10) || 'NICE TO HAVE' || chr(10) || '• ' || source || chr(10) || 'plain line' || chr(10)
  || '* 12+ years of ' || lang || chr(10) || 'Other things:' || chr(10) || '- left out' || chr(10) || 'Responsibilities:' || chr(10)
  || '- ship ' || doc_id || chr(10) AS text FROM documents"""


@register("doc_sections", f"""
WITH lines AS (
  SELECT doc_id, CAST(pos - 1 AS INT) AS pos, trim(line) AS line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM ({SECTIONED_SQL}))),
marked AS (
  SELECT doc_id, pos, line, regexp_matches(line, '{T.BULLET_RE}') AS is_bullet,
    CASE WHEN NOT regexp_matches(line, '{T.BULLET_RE}') AND NOT regexp_matches(line, '{T.RULER_RE}') AND line <> ''
          AND ((line LIKE '%:' AND length(line) <= 40)
               OR (line = upper(line) AND regexp_matches(line, '[A-Z]') AND length(line) <= 60))
         THEN line END AS heading FROM lines),
carried AS (
  SELECT doc_id, pos, line, is_bullet, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM marked)
SELECT * FROM (
  SELECT doc_id, pos,
    CASE WHEN lower(heading) LIKE '%must%' THEN 'must_have'
         WHEN lower(heading) LIKE '%nice%' OR lower(heading) LIKE '%preferred%' OR lower(heading) LIKE '%bonus%' THEN 'nice_to_have'
         WHEN lower(heading) LIKE '%responsib%' THEN 'responsibilities'
         WHEN lower(heading) LIKE '%skill%' THEN 'skills'
         WHEN lower(heading) LIKE '%requirement%' OR lower(heading) LIKE '%qualification%' THEN 'must_have' END AS section,
    heading, regexp_replace(line, '{T.BULLET_RE}', '') AS item,
    TRY_CAST(nullif(regexp_extract(regexp_replace(line, '{T.BULLET_RE}', ''), '{T.YEARS_RE}', 1), '') AS INT) AS years_required
  FROM carried WHERE is_bullet) WHERE section IS NOT NULL""")
def q_doc_sections(spark, d):
    """Documents as postings: their lines are bullets under four headings and rulers."""
    t, nl = F.col("text"), F.lit("\n")
    bullets = F.regexp_replace(t, "\n", "\n- ")
    text = F.concat(F.lit("Must have:\n====\n- 3+ years "), F.col("lang"), F.lit("\n- "), bullets, F.lit("\nNICE TO HAVE\n• "), F.col("source"),
                    F.lit("\nplain line\n* 12+ years of "), F.col("lang"), F.lit("\nOther things:\n- left out\nResponsibilities:\n- ship "),
                    F.col("doc_id").cast("string"), nl)
    return T.sections(Tables(spark, d).documents.select("doc_id", text.alias("text")))


KEYWORDS_SQL = f"""
WITH bw AS (SELECT list_filter(regexp_split_to_array(lower(text), '{WORDS_RE}'), lambda w: w <> '') AS t FROM benchmark)
SELECT DISTINCT w AS keyword FROM (SELECT unnest(t) AS w FROM bw) WHERE length(w) >= 4
UNION SELECT t[i] || ' ' || t[i + 1] FROM (SELECT t, unnest(range(1, len(t))) AS i FROM bw)"""


def v_keywords(t):
    """Keyword dictionary: all words (4 letters and more) and all pairs of neighbouring words of benchmark."""
    tok = t.benchmark.select(words(F.col("text")).alias("_t"))
    pairs = F.transform(F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get("_t", i + 1)))
    single = F.filter("_t", lambda w: F.length(w) >= 4)
    return tok.select(F.explode(F.concat(single, pairs)).alias("keyword")).distinct()


@register("keyword_tags", W([], f"""
SELECT DISTINCT doc_id, keyword FROM (
  SELECT doc_id, unnest(t) AS keyword FROM dw
  UNION ALL SELECT doc_id, t[i] || ' ' || t[i + 1] FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM dw)) JOIN kw USING (keyword)""",
    extra=[("kw", KEYWORDS_SQL), ("dw", f"""SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{WORDS_RE}'),
        lambda w: w <> '') AS t FROM documents""")]))
def q_keyword_tags(spark, d):
    t = Tables(spark, d)
    return T.keyword_tags(t.documents, v_keywords(t))


@register("gap_rows", W([], """
SELECT *, CASE WHEN status = 'met' THEN 'strength' ELSE 'gap' END AS kind,
  CASE WHEN status = 'met' THEN NULL
       WHEN req_type = 'must_have' AND status = 'missing' THEN 'critical'
       WHEN req_type = 'must_have' AND status = 'short' THEN 'high'
       WHEN req_type = 'implicit' THEN 'medium' WHEN req_type = 'nice_to_have' THEN 'low' END AS severity
FROM (SELECT *, CASE WHEN req_id <= 3 THEN 'must_have' WHEN req_id <= 5 THEN 'nice_to_have' ELSE 'implicit' END
        AS req_type FROM m)""", extra=[("m", ORACLES["match_requirements"])]))
def q_gap_rows(spark, d):
    m = q_match_requirements(spark, d)
    m = m.withColumn("req_type", F.when(F.col("req_id") <= 3, "must_have").when(F.col("req_id") <= 5, "nice_to_have")
                     .otherwise("implicit"))
    return T.gap_rows(m)


# Model replies: fenced object, fenced list, object in prose with braces in a string, cut-off object, braces without JSON.
REPLY_SQL = """
SELECT event_id AS id, event_id % 5 AS form, CASE event_id % 5
  WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || o || chr(10) || '```' || chr(10) || 'done {x}'
  WHEN 1 THEN '```' || chr(10) || '[' || o || ',' || o || ']' || chr(10) || '```'
  WHEN 2 THEN 'so ' || o || ' trailing }' WHEN 3 THEN 'cut ' || left(o, length(o) - 2) ELSE 'nothing {broken} ' || props END AS text, o
FROM (SELECT event_id, replace(props, '{', '[') AS props,
        '{"id": ' || event_id || ', "note": "a } b { c", "props": ' || props || '}' AS o FROM events)"""


def _replies(t):
    e, nl = t.events, "\n"
    i, form = F.col("event_id"), F.col("event_id") % 5
    o = F.concat(F.lit('{"id": '), i.cast("string"), F.lit(', "note": "a } b { c", "props": '), F.col("props"), F.lit("}"))
    text = (F.when(form == 0, F.concat(F.lit(f"Here:{nl}```json{nl}"), o, F.lit(f"{nl}```{nl}done {{x}}")))
            .when(form == 1, F.concat(F.lit(f"```{nl}["), o, F.lit(","), o, F.lit(f"]{nl}```")))
            .when(form == 2, F.concat(F.lit("so "), o, F.lit(" trailing }")))
            .when(form == 3, F.concat(F.lit("cut "), F.left(o, F.length(o) - 2)))
            .otherwise(F.concat(F.lit("nothing {broken} "), F.regexp_replace("props", r"\{", "["))))
    return e.select(i.alias("id"), text.alias("text"))


@register("fenced_json", W([], """
SELECT id, CASE form WHEN 0 THEN o WHEN 1 THEN '[' || o || ',' || o || ']' END AS json_text FROM r""", extra=[("r", REPLY_SQL)]))
def q_fenced_json(spark, d):
    c = T.fenced_json("text")
    return _replies(Tables(spark, d)).select("id", F.when(F.try_parse_json(c).isNotNull(), c).alias("json_text"))


@register("balanced_json", W([], """
SELECT id, CASE form WHEN 0 THEN o WHEN 1 THEN '{"charts": [' || o || ',' || o || ']}' WHEN 2 THEN o END AS json_text,
  CASE WHEN form IN (3, 4) THEN 'no valid JSON found' END AS json_error FROM r""", extra=[("r", REPLY_SQL)]))
def q_balanced_json(spark, d):
    return T.json_from_text(_replies(Tables(spark, d)), "text").drop("text")


@register("age_label", """
SELECT event_id, CASE WHEN h < 1 THEN 'Just now' WHEN h < 24 THEN CAST(h AS VARCHAR) || 'h ago'
    WHEN floor(h / 24) < 7 THEN CAST(CAST(floor(h / 24) AS BIGINT) AS VARCHAR) || 'd ago'
    ELSE strftime(ts, '%b %-d, %Y') END AS age
FROM (SELECT event_id, ts, CAST(trunc((epoch_ms(TIMESTAMP '2024-01-25 00:00:00') - epoch_ms(ts)) / 3600000.0) AS BIGINT) AS h
      FROM events)""")
def q_age_label(spark, d):
    ev = Tables(spark, d).events
    now = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return ev.select("event_id", C.age_label("ts", now).alias("age"))


EXP_JOBS_SQL = """
SELECT o_custkey AS cv_id,
  CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m') END AS start_date,
  CASE WHEN o_orderstatus = 'O' THEN 'Present'
       ELSE strftime(o_orderdate + (o_orderkey % 36) * INTERVAL 1 MONTH, '%Y-%m') END AS end_date FROM orders"""


def _exp_jobs(t):
    o = t.orders
    return o.select(
        F.col("o_custkey").alias("cv_id"),
        F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", "yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("start_date"),
        F.when(F.col("o_orderstatus") == "O", F.lit("Present"))
        .otherwise(F.date_format(F.add_months(F.to_date("o_orderdate"), (F.col("o_orderkey") % 36).cast("int")), "yyyy-MM"))
        .alias("end_date"))


def _mi_sql(x: str, now: str = "TIMESTAMP '2002-01-01 00:00:00'") -> str:
    """SQL twin of ``month_index``."""
    return (f"CASE WHEN lower(trim({x})) = 'present' THEN year({now}) * 12 + month({now}) - 1 "
            f"WHEN regexp_matches(trim({x}), '^([0-9]{{4}})-([0-9]{{1,2}})$') "
            f"THEN CAST(split_part(trim({x}), '-', 1) AS INT) * 12 + CAST(split_part(trim({x}), '-', 2) AS INT) - 1 "
            f"WHEN regexp_matches(trim({x}), '^([0-9]{{4}})$') THEN CAST(trim({x}) AS INT) * 12 END")


@register("experience_years", W([], f"""
SELECT cv_id, count(*) AS months, round(count(*) / 12.0, 1) AS years FROM (
  SELECT DISTINCT cv_id, unnest(generate_series(s, e)) AS m FROM (
    SELECT cv_id, {_mi_sql("start_date")} AS s, {_mi_sql("coalesce(end_date, 'Present')")} AS e FROM jobs)
  WHERE s IS NOT NULL AND e IS NOT NULL AND e >= s) GROUP BY cv_id""", extra=[("jobs", EXP_JOBS_SQL)]))
def q_experience_years(spark, d):
    now = F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")
    return T.experience_years(_exp_jobs(Tables(spark, d)), now)


@register("format_salary", W(["v_postings"], """
SELECT id, CASE WHEN coalesce(salary_min, 0) <> 0 OR coalesce(salary_max, 0) <> 0
  THEN '$' || coalesce(format('{:,}', salary_min), '') ||
       CASE WHEN coalesce(salary_max, 0) <> 0 THEN ' - ' || format('{:,}', salary_max) ELSE '+' END END AS salary_label
FROM v_postings"""))
def q_format_salary(spark, d):
    p = V.v_postings(Tables(spark, d))
    return p.select("id", C.format_salary("salary_min", "salary_max").alias("salary_label"))


@register("page_title", f"""
SELECT page_id, nullif(trim(regexp_extract(html, '{T.TITLE_RE}', 1)), '') AS title,
  nullif(regexp_extract(html, '{T.LANG_RE.replace('"', '"')}', 1), '') AS lang
FROM pages""")
def q_page_title(spark, d):
    pg = Tables(spark, d).pages
    f = T.html_fields(pg, decode=False)
    return f.select("page_id", "title", "lang")


def _decoded(expr: str) -> str:
    """The entities of the pages, decoded (the ampersand last)."""
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


_TEXT_NODES = r"""array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(html,
    '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<noscript\b[^>]*>.*?</noscript>', ' ', 'g'),
    '(?s)<[^>]+>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"""


@register("html_text", r"""
SELECT page_id, {title} AS title,
  nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?s)<[^>]+>', '', 'g')), '') AS h1,
  nullif(regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1), '') AS lang,
  nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), '') AS host,
  regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="([^"]*)"', 1) AS links, {text} AS text
FROM pages""".replace("{title}", _decoded("nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')"))
          .replace("{text}", _decoded(_TEXT_NODES)))
def q_html_text(spark, d):
    return T.html_fields(Tables(spark, d).pages).select("page_id", "title", "h1", "lang", "host", "links", "text")


# --------------------------------------------------------------------------- T11
def v_profiles(t):
    """CV and job profiles as nested structs, one per order: its lines are the skills / requirements."""
    o, c, n, li, p = t.orders, t.customer, t.nation, t.lineitem, t.part
    lp = li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "p_name", "p_type", "p_brand")
    level = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0)  # in the order of the words
    # one collect and one sort per order (an order has few lines: bounded), everything else derived after the exchange;
    # sort_array compares by generated code, array_sort by an interpreted function
    line = F.struct(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("k"),
                    "p_name", level.cast("byte").alias("level"), "p_type", "p_brand")
    per = lp.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("_lines")).select(
        "l_orderkey",
        F.transform("_lines", lambda x: F.struct(
            x["p_name"].alias("name"), F.when(x["level"] == 1, "expert").when(x["level"] == 2, "proficient").otherwise("").alias("proficiency"),
            (x["k"]["l_quantity"].cast("int") % 10).alias("years"))).alias("_skills"),
        F.transform("_lines", lambda x: F.struct(
            x["p_name"].alias("text"), F.lower(x["p_type"]).alias("category"),
            F.when(x["k"]["l_linenumber"] > 1, x["k"]["l_linenumber"]).alias("years_required"),
            x["k"]["l_linenumber"].alias("ln"))).alias("_reqs"),
        F.sort_array(F.array_distinct(F.col("_lines")["p_type"])).alias("_types"),
        F.sort_array(F.array_distinct(F.col("_lines")["p_brand"])).alias("_brands"),
        F.aggregate("_lines", F.lit(0).cast("bigint"), lambda acc, x: acc + x["k"]["l_quantity"].cast("int") % 10).alias("_years"),
    )
    base = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(
        per, o.o_orderkey == per.l_orderkey)
    reqs = F.col("_reqs")
    cv = F.struct(
        F.col("c_name").alias("name"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("c_mktsegment")).alias("summary"),
        F.col("_years").cast("int").alias("total_years_experience"),
        F.col("_skills").alias("skills"),
        F.array(F.struct(F.col("n_name").alias("company"), F.col("o_orderpriority").alias("role"),
                         F.date_format("o_orderdate", "yyyy-MM").alias("start_date"),
                         F.when(F.col("o_orderstatus") != "O", F.date_format("o_orderdate", "yyyy")).alias("end_date"),
                         F.col("_types").alias("highlights"),
                         F.when(F.col("o_orderkey") % 3 != 0, F.col("_brands")).alias("technologies"))).alias("experience"),
        F.array().cast("array<struct<degree:string,field:string,institution:string>>").alias("education"),
        F.col("_brands").alias("certifications"),
    )
    job = F.struct(
        F.col("o_orderpriority").alias("role_title"), F.col("n_name").alias("company"),
        F.col("n_name").alias("location"),
        F.when(F.col("o_orderstatus") == "F", "remote").alias("remote_policy"),
        F.lit(None).cast("string").alias("seniority"),
        F.filter(reqs, lambda r: r["ln"] <= 3).alias("must_have"),
        F.filter(reqs, lambda r: r["ln"] > 3).alias("nice_to_have"),
        F.col("_types").alias("responsibilities"),
        F.col("_brands").alias("ats_keywords"),
    )
    return base.select(F.col("o_orderkey").alias("id"), cv.alias("cv"), job.alias("job"))


def _lines_sql(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


NL = "chr(10)"
PROFILE_SQL = f"""
WITH lp AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_returnflag,
              p.p_name, p.p_type, p.p_brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
per AS (SELECT l_orderkey,
  list({{'name': p_name, 'proficiency': CASE l_returnflag WHEN 'A' THEN 'expert' WHEN 'R' THEN 'proficient' ELSE '' END,
         'years': CAST(CAST(l_quantity AS INT) % 10 AS INT)}}
       ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS skills,
  list({{'text': p_name, 'category': lower(p_type), 'years_required': CASE WHEN l_linenumber > 1 THEN l_linenumber END,
         'ln': l_linenumber}} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS reqs,
  list_sort(list_distinct(list(p_type))) AS types, list_sort(list_distinct(list(p_brand))) AS brands,
  CAST(sum(CAST(l_quantity AS INT) % 10) AS INT) AS years
  FROM lp GROUP BY l_orderkey),
b AS (SELECT o.o_orderkey AS id, c.c_name AS name, CASE WHEN o.o_orderkey % 2 = 0 THEN c.c_mktsegment END AS summary,
        per.years, per.skills, n.n_name, o.o_orderpriority AS role, strftime(o.o_orderdate, '%Y-%m') AS start_date,
        CASE WHEN o.o_orderstatus <> 'O' THEN strftime(o.o_orderdate, '%Y') END AS end_date, per.types, per.brands,
        list_filter(per.reqs, lambda r: r.ln <= 3) AS must, list_filter(per.reqs, lambda r: r.ln > 3) AS nice,
        CASE WHEN o.o_orderstatus = 'F' THEN 'remote' END AS remote_policy
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
      JOIN per ON o.o_orderkey = per.l_orderkey)
SELECT id,
  {_lines_sql(
    "'## Candidate: ' || coalesce(name, 'Unknown')", "''",
    f"CASE WHEN summary IS NOT NULL AND summary <> '' THEN '**Summary:** ' || summary || {NL} END",
    f"CASE WHEN years IS NOT NULL AND years <> 0 THEN '**Total Experience:** ' || CAST(years AS VARCHAR) || ' years' || {NL} END",
    f"""CASE WHEN len(skills) > 0 THEN '**Skills:**' || {NL} || array_to_string(list_transform(skills, lambda s:
         '- ' || coalesce(s.name, '') || CASE WHEN s.proficiency IS NOT NULL AND s.proficiency <> '' THEN ' (' || s.proficiency || ')' ELSE '' END
         || CASE WHEN s.years IS NOT NULL AND s.years <> 0 THEN ' - ' || CAST(s.years AS VARCHAR) || ' years' ELSE '' END), {NL}) || {NL} END""",
    f"""'**Work Experience:**' || {NL} || {NL} || '### ' || coalesce(role, '') || ' at ' || coalesce(n_name, '') || ' ('
         || coalesce(start_date, '') || ' - ' || coalesce(end_date, 'Present') || ')'
         || CASE WHEN len(types) > 0 THEN {NL} || array_to_string(list_transform(types, lambda h: '  - ' || h), {NL}) ELSE '' END
         || CASE WHEN id % 3 <> 0 AND len(brands) > 0 THEN {NL} || '  Technologies: ' || array_to_string(brands, ', ') ELSE '' END
         || {NL}""",
    f"CASE WHEN len(brands) > 0 THEN '**Certifications:** ' || array_to_string(brands, ', ') || {NL} END",
  )} AS cv_text,
  {_lines_sql(
    "'## Job: ' || coalesce(role, 'Unknown Role') || ' at ' || coalesce(n_name, 'Unknown Company')", "''",
    "CASE WHEN n_name IS NOT NULL AND n_name <> '' THEN '**Location:** ' || n_name || ' (' || coalesce(remote_policy, 'unknown') || ')' END",
    "''",
    f"""CASE WHEN len(must) > 0 THEN '**Must-Have Requirements:**' || {NL} || array_to_string(list_transform(must, lambda r:
         '- ' || coalesce(r.text, '') || CASE WHEN r.years_required IS NOT NULL AND r.years_required <> 0
         THEN ' (' || CAST(r.years_required AS VARCHAR) || '+ years)' ELSE '' END
         || CASE WHEN r.category IS NOT NULL AND r.category <> '' THEN ' [' || r.category || ']' ELSE '' END), {NL}) || {NL} END""",
    f"""CASE WHEN len(nice) > 0 THEN '**Nice-to-Have:**' || {NL} || array_to_string(list_transform(nice, lambda r:
         '- ' || coalesce(r.text, '')), {NL}) || {NL} END""",
    f"""CASE WHEN len(types) > 0 THEN '**Responsibilities:**' || {NL} || array_to_string(list_transform(types, lambda r:
         '- ' || r), {NL}) || {NL} END""",
    f"CASE WHEN len(brands) > 0 THEN '**Key ATS Keywords:** ' || array_to_string(brands, ', ') || {NL} END",
  )} AS job_text
FROM b"""


@register("render_profile", PROFILE_SQL)
def q_render_profile(spark, d):
    pr = v_profiles(Tables(spark, d))
    return pr.select("id", T.render_cv(F.col("cv")).alias("cv_text"), T.render_job(F.col("job")).alias("job_text"))


CARD_PAGES_SQL = """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'jsonld' ELSE 'mosaic' END AS kind, CAST(0 AS BIGINT) AS pos, 'indeed' AS source,
  'Role ' || page_id AS role_title, 'Co ' || (page_id % 7) AS company_name, CASE page_id % 4 WHEN 1 THEN 'Oslo, NO' ELSE 'Remote' END AS location,
  'text ' || page_id AS description_text, (page_id % 90 + 10) * 1000 AS salary_min, (page_id % 90 + 50) * 1000 AS salary_max,
  CASE page_id % 4 WHEN 1 THEN 'https://jobs.example/' || page_id ELSE 'https://www.indeed.com/viewjob?jk=' || lower(to_hex(page_id)) END AS source_url,
  CASE page_id % 4 WHEN 1 THEN 'id' || page_id ELSE lower(to_hex(page_id)) END AS source_job_id,
  CASE page_id % 4 WHEN 1 THEN '' ELSE 'remote' END AS remote_policy
FROM pages WHERE page_id % 4 < 3"""


@register("extract_postings", CARD_PAGES_SQL)
def q_extract_postings(spark, d):
    """The pages with a card, a JSON-LD block or provider data behind their own markup (a quarter has none)."""
    from talentlake.sources.postings import extract_postings

    n = F.col("page_id")
    put = {"n": n.cast("string"), "k": F.lower(F.hex(n)), "c": (n % 7).cast("string"), "lo": (n % 90 + 10).cast("string"), "hi": (n % 90 + 50).cast("string")}
    card = ('<div class="job_seen_beacon"><h2 class="jobTitle"><a href="/rc?jk=@k&x=1">Role @n</a></h2><span class="companyName">Co @c</span>'
            '<div class="companyLocation">Remote</div><div class="salary-snippet-container">$@lo,000 - $@hi,000 a year</div>'
            '<div class="job-snippet">text @n</div></div>')
    linked = ('<script type="application/ld+json">{"@type":"JobPosting","title":"Role @n","hiringOrganization":{"name":"Co @c"},'
              '"jobLocation":{"address":{"addressLocality":"Oslo","addressRegion":"NO"}},"description":"<p>text @n</p>",'
              '"baseSalary":{"value":{"minValue":@lo000,"maxValue":@hi000}},"url":"https://jobs.example/@n","identifier":{"value":"id@n"}}</script>')
    provider = ('<script id="mosaic-provider-jobcards">window.mosaic.providerData["mosaic-provider-jobcards"]={"metaData":'
                '{"mosaicProviderJobCardsModel":{"results":[{"title":"Role @n","company":"Co @c","formattedLocation":"Remote","snippet":"text @n",'
                '"formattedSalary":"$@lo,000 - $@hi,000 a year","jobkey":"@k"}]}}};</script>')

    def filled(template: str):
        out = F.lit(template)
        for name, value in put.items():
            out = F.replace(out, F.lit(f"@{name}"), value)
        return out

    extra = F.when(n % 4 == 0, filled(card)).when(n % 4 == 1, filled(linked)).when(n % 4 == 2, filled(provider)).otherwise("")
    return extract_postings(Tables(spark, d).pages.select("page_id", F.concat("html", extra).alias("html")))
