"""The §2.12 views as DuckDB SQL, used only by the oracle queries.

``with_views(["v_applications"], "SELECT ...")`` prefixes the body with the
needed common table expressions.  Extra CTEs of a query go in ``extra``.
"""

from __future__ import annotations

VIEW_SQL: dict[str, str] = {
    "v_applications": """
SELECT o.o_orderkey AS id, o.o_custkey AS user_id, o.o_orderkey AS job_id,
  CASE o.o_orderkey % 11 WHEN 0 THEN 'saved' WHEN 1 THEN 'applied' WHEN 2 THEN 'screening' WHEN 3 THEN 'phone_screen'
    WHEN 4 THEN 'interview' WHEN 5 THEN 'technical' WHEN 6 THEN 'onsite' WHEN 7 THEN 'offer' WHEN 8 THEN 'rejected'
    WHEN 9 THEN 'withdrawn' ELSE 'accepted' END AS status,
  o.o_orderpriority AS role_title, n.n_name AS company_name, CAST(floor(o.o_totalprice / 5000) AS INT) AS fit_score,
  o.o_orderdate AS created_at, CASE WHEN o.o_orderkey % 11 <> 0 THEN o.o_orderdate END AS applied_at,
  CASE WHEN o.o_orderkey % 11 BETWEEN 3 AND 8 OR o.o_orderkey % 11 = 10
    THEN o.o_orderdate + (o.o_orderkey % 30) * INTERVAL '1' DAY END AS response_date
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "v_gaps": """
SELECT l.l_orderkey AS app_id, l.l_linenumber AS pos, CASE WHEN p.p_size % 10 = 0 THEN NULL ELSE p.p_name END AS missing_element,
  p.p_type AS requirement, CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN 'critical' WHEN l.l_returnflag = 'R' THEN 'high'
    WHEN l.l_returnflag = 'A' THEN 'medium' ELSE 'low' END AS severity, p.p_brand AS recommendation
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "v_cv": """
SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS version_name, o_orderkey % 4 = 0 AS is_primary,
  o_orderdate AS created_at FROM orders""",
    "v_analyses": """
SELECT o_orderkey AS id, o_orderkey * 4 // 15 AS job_id, o_custkey AS cv_version_id, CAST(floor(o_totalprice / 5000) AS INT) AS fit_score,
  CAST(o_orderkey % 101 AS INT) AS ats_score, o_orderdate AS created_at FROM orders""",
    "v_findings": """
SELECT d.doc_id AS id, d.source AS topic, CASE d.doc_id % 4 WHEN 0 THEN 'role_trend' WHEN 1 THEN 'skill_demand'
    WHEN 2 THEN 'salary_insight' ELSE 'industry_news' END AS category, d.text AS title,
  CAST(d.n_chars % 101 AS INT) AS relevance_score, coalesce(b.quality = 1, false) AS is_featured,
  TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL '1' MINUTE AS created_at
FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id""",
    "v_postings": """
SELECT p.p_partkey AS id, CASE p.p_partkey % 2 WHEN 0 THEN 'indeed' ELSE 'glassdoor' END AS source,
  concat('jk', CAST(p.p_partkey * 3 // 4 AS VARCHAR)) AS source_job_id, p.p_name AS role_title, p.p_brand AS company_name,
  n.n_name AS location,
  CASE p.p_partkey % 5 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid remote' WHEN 2 THEN 'On-site only' WHEN 3 THEN 'In-office' ELSE '' END AS policy_text,
  CAST(round(p.p_retailprice * 100) AS INT) AS salary_min,
  CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE CAST(round(p.p_retailprice * 150) AS INT) END AS salary_max,
  p.p_partkey % 9 <> 0 AS is_active, TIMESTAMP '2024-01-01 00:00:00' + (p.p_partkey % 700) * INTERVAL '1' HOUR AS discovered_at
FROM part p JOIN nation n ON p.p_partkey % 25 = n.n_nationkey""",
    "v_salary": """
SELECT p_partkey AS id, CASE p_partkey % 6
    WHEN 0 THEN concat('$', CAST(p_size + 80 AS VARCHAR), 'K - $', CAST(p_size + 120 AS VARCHAR), 'K a year')
    WHEN 1 THEN concat('$', CAST(p_size + 20 AS VARCHAR), ' an hour') WHEN 2 THEN concat('$', CAST(p_size + 900 AS VARCHAR), ' a week')
    WHEN 3 THEN 'Competitive, great team' WHEN 4 THEN concat(CAST(p_size + 100 AS VARCHAR), ',000.50') ELSE NULL END AS salary_text
FROM part""",
    "v_status_events": """
SELECT event_id, user_id * 1000 + day(ts) AS job_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing'
    WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status, ts, value FROM events""",
}


# views that read other views
VIEW_DEPS: dict[str, list[str]] = {"v_posting_skills": ["v_postings"]}


def _expand(views: list[str]) -> list[str]:
    out: list[str] = []
    for name in views:
        for dep in _expand(VIEW_DEPS.get(name, [])) + [name]:
            if dep not in out:
                out.append(dep)
    return out


def with_views(views: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    parts = [f"{name} AS ({VIEW_SQL[name].strip()})" for name in _expand(views)]
    parts += [f"{name} AS ({sql.strip()})" for name, sql in (extra or [])]
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()

VIEW_SQL["v_evaluations"] = """
SELECT conv_id AS session_id, turn AS question_id, CAST(length(text) % 5 + 1 AS INT) AS score,
  CAST((length(text) + 1) % 5 + 1 AS INT) AS clarity, CAST((length(text) + 2) % 5 + 1 AS INT) AS relevance,
  CAST(turn % 5 + 1 AS INT) AS depth, CASE WHEN turn % 3 <> 0 THEN length(text) % 2 = 0 END AS star_method_used
FROM conversations WHERE role = 'user'"""

VIEW_SQL["v_posting_skills"] = """
SELECT id AS posting_id, company_name AS company, unnest(string_split(role_title, ' ')) AS skill FROM v_postings"""
