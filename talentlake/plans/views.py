"""Career-shaped views over the test tables, written with the DataFrame API.

The same views are written again, by hand, as SQL for the DuckDB oracle in
``talentlake.plans.oracle_views``.  Each view is a projection or a join of the
given tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentlake.operators.merge import FINDING_CATEGORIES
from talentlake.sources.tables import Tables

# The eleven application statuses, in pipeline order.
APPLICATION_STATUSES = [
    "saved", "applied", "screening", "phone_screen", "interview", "technical",
    "onsite", "offer", "rejected", "withdrawn", "accepted",
]


def _case_mod(col: Column, labels: list[str]) -> Column:
    """``CASE col WHEN 0 THEN labels[0] ... ELSE labels[-1] END``."""
    expr = None
    for i, label in enumerate(labels[:-1]):
        expr = F.when(col == i, F.lit(label)) if expr is None else expr.when(col == i, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def v_applications(t: Tables) -> DataFrame:
    o, c, n = t.orders, t.customer, t.nation
    k = F.col("o_orderkey") % 11
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderkey").alias("job_id"),
            _case_mod(k, APPLICATION_STATUSES).alias("status"),
            F.col("o_orderpriority").alias("role_title"),
            F.col("n_name").alias("company_name"),
            F.floor(F.col("o_totalprice") / 5000).cast("int").alias("fit_score"),
            F.col("o_orderdate").alias("created_at"),
            F.when(k != 0, F.col("o_orderdate")).alias("applied_at"),
            F.when(k.between(3, 8) | (k == 10),
                   F.timestamp_add("DAY", F.col("o_orderkey") % 30, F.col("o_orderdate"))).alias("response_date"),
        )
    )


def v_gaps(t: Tables) -> DataFrame:
    li, p = t.lineitem, t.part
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("app_id"),
        F.col("l_linenumber").alias("pos"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_name")).alias("missing_element"),
        F.col("p_type").alias("requirement"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "critical")
        .when(F.col("l_returnflag") == "R", "high")
        .when(F.col("l_returnflag") == "A", "medium")
        .otherwise("low").alias("severity"),
        F.col("p_brand").alias("recommendation"),
    )


def v_cv(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("version_name"),
        (F.col("o_orderkey") % 4 == 0).alias("is_primary"),
        F.col("o_orderdate").alias("created_at"),
    )


def v_analyses(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.expr("o_orderkey * 4 div 15").alias("job_id"),
        F.col("o_custkey").alias("cv_version_id"),
        F.floor(F.col("o_totalprice") / 5000).cast("int").alias("fit_score"),
        (F.col("o_orderkey") % 101).cast("int").alias("ats_score"),
        F.col("o_orderdate").alias("created_at"),
    )


def v_findings(t: Tables) -> DataFrame:
    d, b = t.documents, t.labels
    return d.join(b, d.doc_id == b.doc_id, "left").select(
        d.doc_id.alias("id"),
        F.col("source").alias("topic"),
        _case_mod(d.doc_id % 4, FINDING_CATEGORIES).alias("category"),
        F.col("text").alias("title"),
        (F.col("n_chars") % 101).cast("int").alias("relevance_score"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_featured"),
        F.timestamp_add("MINUTE", d.doc_id, _ts("2024-01-01 00:00:00")).alias("created_at"),
    )


def v_postings(t: Tables) -> DataFrame:
    p, n = t.part, t.nation
    # nation is a fixed 25-row dimension: broadcasting it is size-bounded.
    return p.join(F.broadcast(n), (p.p_partkey % 25) == n.n_nationkey).select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 2 == 0, "indeed").otherwise("glassdoor").alias("source"),
        F.concat(F.lit("jk"), F.expr("p_partkey * 3 div 4").cast("string")).alias("source_job_id"),
        F.col("p_name").alias("role_title"),
        F.col("p_brand").alias("company_name"),
        F.col("n_name").alias("location"),
        _case_mod(F.col("p_partkey") % 5, ["Remote", "Hybrid remote", "On-site only", "In-office", ""]).alias("policy_text"),
        F.round(F.col("p_retailprice") * 100).cast("int").alias("salary_min"),
        F.when(F.col("p_partkey") % 7 != 0, F.round(F.col("p_retailprice") * 150).cast("int")).alias("salary_max"),
        (F.col("p_partkey") % 9 != 0).alias("is_active"),
        F.timestamp_add("HOUR", F.col("p_partkey") % 700, _ts("2024-01-01 00:00:00")).alias("discovered_at"),
    )


def v_salary(t: Tables) -> DataFrame:
    m = F.col("p_partkey") % 6
    s = F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.when(m == 0, F.concat(F.lit("$"), (s + 80).cast("string"), F.lit("K - $"), (s + 120).cast("string"), F.lit("K a year")))
        .when(m == 1, F.concat(F.lit("$"), (s + 20).cast("string"), F.lit(" an hour")))
        .when(m == 2, F.concat(F.lit("$"), (s + 900).cast("string"), F.lit(" a week")))
        .when(m == 3, F.lit("Competitive, great team"))
        .when(m == 4, F.concat((s + 100).cast("string"), F.lit(",000.50")))
        .alias("salary_text"),
    )


def v_status_events(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        "event_id",
        (F.col("user_id") * 1000 + F.dayofmonth("ts")).alias("job_id"),
        F.when(F.col("event_type") == "signup", "pending")
        .when(F.col("event_type") == "view", "processing")
        .when(F.col("event_type") == "purchase", "completed")
        .when(F.col("event_type") == "error", "failed")
        .otherwise("cancelled").alias("status"),
        "ts",
        "value",
    )


def v_evaluations(t: Tables) -> DataFrame:
    """Answer evaluations from conversations: user turns are answers, scores derived from the text."""
    n = F.length("text")
    return t.conversations.where(F.col("role") == "user").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("question_id"),
        (n % 5 + 1).cast("int").alias("score"),
        ((n + 1) % 5 + 1).cast("int").alias("clarity"),
        ((n + 2) % 5 + 1).cast("int").alias("relevance"),
        (F.col("turn") % 5 + 1).cast("int").alias("depth"),
        F.when(F.col("turn") % 3 != 0, n % 2 == 0).alias("star_method_used"),
    )


def v_posting_skills(t: Tables) -> DataFrame:
    """One row per (posting, keyword): keywords are the words of the posting title."""
    p = v_postings(t)
    return p.select(
        F.col("id").alias("posting_id"),
        F.col("company_name").alias("company"),
        F.explode(F.split(F.col("role_title"), " ")).alias("skill"),
    )
