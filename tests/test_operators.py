"""Hand-written rows for NULL, tie, empty and malformed input (FIXTURES §3 cases)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talentlake.functions import columns as C
from talentlake.functions import text as T
from talentlake.operators import aggs, filters, joins, merge, ranking, sets, work
from talentlake.sources import ingest


def ts(s):
    return dt.datetime.fromisoformat(s)


# ----------------------------------------------------------------------------- T1 / T2 / T16
@pytest.mark.parametrize("text,lo,hi", [
    ("$120K - $180K a year", 120000, 180000),
    ("$85 an hour", 85, 85),
    ("$900 a week", 900, 900),
    ("Competitive, great team", 0, 0),
    ("180,000", 180000, 180000),
    ("", 0, 0),
    (None, 0, 0),
    ("120,000.50", 120000, 120000),
])
def test_parse_salary(spark, text, lo, hi):
    r = spark.createDataFrame([(text,)], "t STRING").select(C.parse_salary("t").alias("s")).first().s
    assert (r.salary_min, r.salary_max) == (lo, hi)


def test_parse_salary_reference_mode_multiplies_week(spark):
    r = spark.createDataFrame([("$900 a week",)], "t STRING").select(C.parse_salary("t", strict_ref=True).alias("s")).first().s
    assert (r.salary_min, r.salary_max) == (900000, 900000)


@pytest.mark.parametrize("text,expected", [
    ("Remote", "remote"), ("Hybrid remote", "hybrid"), ("On-site only", "onsite"), ("in-office", "onsite"),
    ("Onsite", "onsite"), ("Austin, TX", ""), (None, ""),
])
def test_remote_policy(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t STRING").select(C.remote_policy("t").alias("r")).first().r == expected


def test_format_salary(spark):
    df = spark.createDataFrame([(90000, 135000), (90000, None), (None, None), (0, 0)], "lo INT, hi INT")
    got = [r.s for r in df.select(C.format_salary("lo", "hi").alias("s")).collect()]
    assert got == ["$90,000 - 135,000", "$90,000+", None, None]


# ----------------------------------------------------------------------------- D
def test_status_breakdown_missing_status_and_pct(spark):
    df = spark.createDataFrame([("u", "applied"), ("u", None), ("u", "applied"), ("v", "saved")], "user_id STRING, status STRING")
    got = {(r.user_id, r.status): (r["count"], r.pct) for r in aggs.status_breakdown(df, by="user_id").collect()}
    assert got == {("u", "applied"): (2, 66.7), ("u", "unknown"): (1, 33.3), ("v", "saved"): (1, 100.0)}


def test_stage_funnel_zero_denominators(spark):
    df = spark.createDataFrame([("saved",), ("saved",)], "status STRING")
    r = aggs.stage_funnel(df).first()
    assert (r.saved, r.applied, r.response_rate, r.offer_rate) == (2, 0, None, None)


def test_avg_fit_excludes_zero_and_null(spark):
    df = spark.createDataFrame([(0,), (None,), (80,), (91,)], "fit_score INT")
    r = aggs.avg_fit(df).first()
    assert (r.avg_fit, r.scored) == (85.5, 2)


def test_fit_bands_shows_empty_bands(spark):
    df = spark.createDataFrame([(95,)], "fit_score INT")
    got = {r.band: r["count"] for r in aggs.fit_bands(df, "chart").collect()}
    assert got == {"90-100": 1, "75-89": 0, "60-74": 0, "Below 60": 0}


def test_gap_frequency_ties_and_fallbacks(spark):
    df = spark.createDataFrame([(None, "Go"), ("K8s", "x"), (None, None), ("Go", "y")], "missing_element STRING, requirement STRING")
    got = [(r.skill, r["count"]) for r in aggs.gap_frequency(df, k=2).collect()]
    assert got == [("Go", 2), ("K8s", 1)]


def test_dashboard_kpis_no_fanout(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id INT")
    cv = spark.createDataFrame([(1,), (1,)], "user_id INT")
    jobs = spark.createDataFrame([(10, 1), (11, 1)], "id INT, user_id INT")
    an = spark.createDataFrame([(10, 80), (10, 0), (11, 90)], "job_id INT, fit_score INT")
    got = {r.user_id: (r.cv_count, r.job_count, r.analysis_count, r.avg_fit) for r in aggs.dashboard_kpis(users, cv, jobs, an).collect()}
    assert got == {1: (2, 2, 3, 56.7), 2: (0, 0, 0, None)}


def test_application_trend_zero_fill(spark):
    df = spark.createDataFrame([(ts("2024-01-05"),), (ts("2024-03-02"),)], "created_at TIMESTAMP_NTZ")
    got = [(r.period.month, r["count"]) for r in aggs.application_trend(df).orderBy("period").collect()]
    assert got == [(1, 1), (2, 0), (3, 1)]


# ----------------------------------------------------------------------------- E
def test_latest_n_nulls_first_and_ties_by_id(spark):
    df = spark.createDataFrame([(1, "u", ts("2024-01-01")), (2, "u", ts("2024-01-01")), (3, "u", None), (4, "u", ts("2023-01-01"))],
                               "id INT, user_id STRING, created_at TIMESTAMP_NTZ")
    got = [r.id for r in ranking.latest_n(df, "user_id", "created_at", 3).orderBy("rank").collect()]
    assert got == [3, 1, 2]
    assert ranking.latest_n(df, "user_id", "created_at", 0).count() == 0
    with pytest.raises(ValueError):
        ranking.latest_n(df, "user_id", "created_at", -1)


def test_ranked_feed_caps_and_rejects_negative(spark):
    df = spark.range(100).withColumnRenamed("id", "x")
    assert ranking.ranked_feed(df, [F.col("x")], limit=80, cap=50).count() == 50
    with pytest.raises(ValueError):
        ranking.ranked_feed(df, [F.col("x")], limit=-1)


def test_dedupe_first_keeps_first_seen(spark):
    df = spark.createDataFrame([(1, "jk1", "A", "X", 5), (2, "jk1", "B", "Y", 3), (3, "", "Eng", "Co", 1),
                                (4, None, "eng ", "co", 2), (5, "", "", "", 9)],
                               "id INT, source_job_id STRING, role_title STRING, company_name STRING, seen INT")
    got = {r.dedupe_key: r.id for r in ranking.dedupe_first(df, ranking.dedupe_key(), ["seen"]).collect()}
    # without source id: role and company put together, case kept
    assert got == {"jk1": 2, "EngCo": 3, "eng co": 4}


def test_single_primary_last_change_wins(spark):
    cv = spark.createDataFrame([(1, "u", True), (2, "u", False), (3, "v", True)], "id INT, user_id STRING, is_primary BOOLEAN")
    ch = spark.createDataFrame([(2, "u", 1), (1, "u", 2)], "cv_id INT, user_id STRING, ts INT")
    got = {r.id: r.is_primary for r in ranking.enforce_single_primary(cv, ch).collect()}
    assert got == {1: True, 2: False, 3: True}


# ----------------------------------------------------------------------------- S / C
def test_keyword_sets(spark):
    df = spark.createDataFrame([(["go", "sql"], ["sql", "k8s", "go", "aws"])], "cv ARRAY<STRING>, job ARRAY<STRING>")
    p, m = sets.keyword_sets(F.col("cv"), F.col("job"))
    r = df.select(p.alias("p"), m.alias("m"), C.ats_score(p, F.col("job")).alias("s")).first()
    assert (r.p, r.m, r.s) == (["go", "sql"], ["aws", "k8s"], 50)


def test_not_yet_saved_null_url(spark):
    disc = spark.createDataFrame([("u", None, "Eng"), ("u", "a", "Eng")], "user_id STRING, source_url STRING, role_title STRING")
    saved = spark.createDataFrame([("u", None, "Eng")], "user_id STRING, source_url STRING, role_title STRING")
    assert [r.source_url for r in joins.not_yet_saved(disc, saved).collect()] == ["a"]


def test_match_requirements_statuses(spark):
    pairs = spark.createDataFrame([(1, 10)], "cv_id INT, job_id INT")
    reqs = spark.createDataFrame([(10, 1, "go", 3), (10, 2, "sql", None), (10, 3, "k8s", 2)],
                                 "job_id INT, req_id INT, skill STRING, years_required INT")
    cvs = spark.createDataFrame([(1, "go", 5), (1, "k8s", 1), (1, "sql", None)], "cv_id INT, skill STRING, years INT")
    got = {r.skill: r.status for r in joins.match_requirements(pairs, reqs, cvs).collect()}
    assert got == {"go": "met", "sql": "met", "k8s": "short"}


def test_phrase_match_whole_words_and_no_cartesian(spark):
    texts = spark.createDataFrame([(1, "Senior Data Engineer, remote"), (2, "Engineering manager")], "id INT, t STRING")
    phrases = spark.createDataFrame([("p1", "data engineer"), ("p2", "engineer")], "pid STRING, ph STRING")
    out = joins.phrase_match(texts, "id", "t", phrases, "pid", "ph")
    assert sorted((r.id, r.pid) for r in out.collect()) == [(1, "p1"), (1, "p2")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_canonical_skills_aliases(spark):
    dim = spark.createDataFrame([("Kubernetes", ["k8s", "K8S "]), ("Go", ["golang"])], "name STRING, aliases ARRAY<STRING>")
    df = spark.createDataFrame([(" k8s",), ("Golang",), ("rust",)], "skill STRING")
    got = {r.skill: r.canonical_skill for r in joins.canonical_skills(df, dim).collect()}
    assert got == {" k8s": "Kubernetes", "Golang": "Go", "rust": "rust"}


# ----------------------------------------------------------------------------- B / T
def test_contains_ci_escapes_wildcards(spark):
    df = spark.createDataFrame([("a_b",), ("axb",)], "s STRING")
    assert [r.s for r in filters.contains_ci(df, "s", "A_B").collect()] == ["a_b"]
    assert sorted(r.s for r in filters.contains_ci(df, "s", "A_B", raw=True).collect()) == ["a_b", "axb"]


def test_truncate_payload(spark):
    df = spark.createDataFrame([("x" * 2005, ["a"] * 12)], "t STRING, xs ARRAY<STRING>")
    r = filters.truncate_payload(df, ["t", "xs"], n=2000).first()
    assert r.t.endswith("... [truncated, total 2005 chars]") and len(r.xs) == 10


def test_compose_text_fallback(spark):
    df = spark.createDataFrame([(None, None, "Dev", "Co", None)],
                               "description_text STRING, requirements_text STRING, role_title STRING, company_name STRING, location STRING")
    assert df.select(filters.compose_text().alias("t")).first().t == "Job: Dev at Co\n\nLocation: Not specified"


JSON_CASES = [
    ('Here:\n```json\n{"a": 1}\n```', '{"a": 1}'),
    ('noise {"a": "x}y", "b": {"c": 2}} tail', '{"a": "x}y", "b": {"c": 2}}'),
    ('```\n[{"k": 1}]\n```', '{"charts": [{"k": 1}]}'),
    ('{"a": 1', None),
    ("no json at all", None),
]


@pytest.mark.parametrize("text,expected", JSON_CASES)
def test_json_from_text(spark, text, expected):
    r = T.json_from_text(spark.createDataFrame([(text,)], "t STRING"), "t").first()
    assert r.json_text == expected
    assert (r.json_error is None) == (expected is not None)


SAMPLE_POSTING = """SENIOR BACKEND ENGINEER
========
Company:    TechCo
RESPONSIBILITIES
========
• Design services
• Mentor developers
Must Have:
----------
• 5+ years of experience in backend development
• Python or Go
Nice to Have:
-------------
• Kafka
"""


def test_sections_on_posting_text(spark):
    df = spark.createDataFrame([(1, SAMPLE_POSTING)], "doc_id INT, text STRING")
    got = [(r.section, r.item, r.years_required) for r in T.sections(df).orderBy("pos").collect()]
    assert got == [("responsibilities", "Design services", None), ("responsibilities", "Mentor developers", None),
                   ("must_have", "5+ years of experience in backend development", 5), ("must_have", "Python or Go", None),
                   ("nice_to_have", "Kafka", None)]


def test_experience_years_merges_overlaps(spark):
    jobs = spark.createDataFrame([(1, "2020-01", "2020-12"), (1, "2020-06", "2021-03"), (1, "2023", None), (2, "bad", "2020")],
                                 "cv_id INT, start_date STRING, end_date STRING")
    now = F.lit("2023-06-15 00:00:00").cast("timestamp_ntz")
    got = {r.cv_id: r.months for r in T.experience_years(jobs, now).collect()}
    assert got == {1: 15 + 6}


def test_contact_fields(spark):
    df = spark.createDataFrame([("Jane jane.doe@mail.com +1 (555) 123-4567 linkedin.com/in/jane github.com/jd",)], "text STRING")
    r = T.contact_fields(df).first()
    assert (r.email, r.phone, r.linkedin_url, r.github_url) == (
        "jane.doe@mail.com", "+1 (555) 123-4567", "linkedin.com/in/jane", "github.com/jd")


# ----------------------------------------------------------------------------- A
def test_merge_upsert_dups_null_keys_and_replay(spark):
    target = spark.createDataFrame([(1, "indeed", "a", "old-url", "Old", 10, True, ts("2024-01-01"))],
                                   "id INT, source STRING, source_job_id STRING, source_url STRING, company_name STRING, "
                                   "salary_min INT, is_active BOOLEAN, updated_at TIMESTAMP_NTZ")
    up = spark.createDataFrame([(7, "indeed", "a", "new-url", "New1", 20, 1), (8, "indeed", "a", "x", "New2", 30, 2),
                                (9, "indeed", None, "n", "NoKey", 5, 3), (10, "indeed", "b", "b1", "B1", 1, 4),
                                (11, "indeed", "b", "b2", "B2", 2, 5)],
                               "id INT, source STRING, source_job_id STRING, source_url STRING, company_name STRING, "
                               "salary_min INT, arrival INT")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    out = merge.merge_upsert(target, up, ["source", "source_job_id"], ["company_name", "salary_min"], "arrival", now)
    got = {r.source_job_id: (r.id, r.source_url, r.company_name, r.salary_min) for r in out.collect()}
    assert got == {"a": (1, "old-url", "New2", 30), "9": (9, "n", "NoKey", 5), "b": (10, "b1", "B2", 2)}
    # replaying the same batch on the result gives the same table (idempotent content)
    again = merge.merge_upsert(out, up, ["source", "source_job_id"], ["company_name", "salary_min"], "arrival", now)
    assert sorted(map(tuple, again.drop("updated_at").collect())) == sorted(map(tuple, out.drop("updated_at").collect()))


def test_apply_patches_latest_non_null_and_positive(spark):
    t = spark.createDataFrame([(1, "a", 100)], "id INT, name STRING, salary INT")
    p = spark.createDataFrame([(1, "b", 200, 1), (1, None, 0, 2), (1, "c", None, 3)], "id INT, name STRING, salary INT, ord INT")
    r = merge.apply_patches(t, p, "id", ["name", "salary"], "ord", positive=["salary"]).first()
    assert (r.name, r.salary) == ("c", 200)


def test_insert_if_absent_names(spark):
    users = spark.createDataFrame([("u1", "Ann", "a@x", ["r"])], "clerk_user_id STRING, name STRING, email STRING, target_roles ARRAY<STRING>")
    signups = spark.createDataFrame([("u1", "Zed", "z@x", 1), ("u2", "", "bob@x.com", 2), ("u2", "Late", "l@x", 3), ("u3", None, None, 4)],
                                    "clerk_user_id STRING, token_name STRING, email STRING, arrival INT")
    got = {r.clerk_user_id: (r.name, r.target_roles) for r in merge.insert_if_absent(users, signups, "clerk_user_id", "arrival",
                                                                                       default_arrays=["target_roles"]).collect()}
    assert got == {"u1": ("Ann", ["r"]), "u2": ("bob", []), "u3": ("New User", [])}


def test_admit_files_written_by_test(spark, tmp_path):
    (tmp_path / "ok.pdf").write_bytes(b"%PDF-1.4 " + b"x" * 200)
    (tmp_path / "small.pdf").write_bytes(b"%PDF")
    (tmp_path / "fake.pdf").write_bytes(b"<html>" + b"x" * 200)
    files = ingest.read_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: r.reject_reason for r in ingest.admit_files(files).collect()}
    assert got == {"ok.pdf": None, "small.pdf": "too_small", "fake.pdf": "not_pdf"}


def test_route_batch(spark):
    body = '{"batch": [{"type": "cv", "text": "x"}, {"type": "job", "text": " "}, {"type": "pdf", "text": "y"}]}'
    df = spark.createDataFrame([(1, body), (2, '{"batch": []}')], "message_id INT, body STRING")
    got = [(r.message_id, r.pos, r.route, r.error) for r in ingest.route_batch(df).orderBy("message_id", "pos").collect()]
    assert got == [(1, 0, "cv", None), (1, 1, None, "empty text"), (1, 2, None, "unknown type: pdf"), (2, None, None, "empty batch")]


# ----------------------------------------------------------------------------- W
EVENT_SEQS = [
    ["processing", "completed"], ["completed", "processing", "failed", "completed"], ["cancelled", "processing", "completed"],
    ["pending"], ["processing", "completed", "processing"], ["failed", "cancelled", "completed"], ["completed", "completed"],
]


def test_lifecycle_closed_form_equals_fold(spark):
    rows = []
    for j, seq in enumerate(EVENT_SEQS):
        for i, st in enumerate(seq):
            rows.append((j, j * 100 + i, st, ts("2024-01-01") + dt.timedelta(minutes=i)))
    import random

    random.seed(3)
    for j in range(len(EVENT_SEQS), 300):
        seq = [random.choice(["pending", "processing", "completed", "failed", "cancelled"]) for _ in range(random.randint(1, 7))]
        EVENT_SEQS.append(seq)
        for i, st in enumerate(seq):
            rows.append((j, j * 100 + i, st, ts("2024-01-01") + dt.timedelta(minutes=i)))
    ev = spark.createDataFrame(rows, "job_id INT, event_id INT, status STRING, ts TIMESTAMP_NTZ")
    got = {r.job_id: r.state for r in work.job_lifecycle(ev).collect()}
    assert got == {j: work.fold_lifecycle(seq) for j, seq in enumerate(EVENT_SEQS)}


def test_application_state_rejects_unknown(spark):
    ch = spark.createDataFrame([(1, "applied", 1, "n1"), (1, "cancelled", 2, ""), (1, "interview", 3, "")],
                               "app_id INT, status STRING, ts INT, notes STRING")
    r = work.application_state(ch).first()
    assert (r.status, r.applied_at, r.notes, r.rejected_changes) == ("interview", 1, "n1", 1)


def test_top_k_approx_matches_exact_on_skewed_labels(spark):
    rows = [("hot",)] * 500 + [(f"w{i % 40}",) for i in range(400)] + [("warm",)] * 60
    df = spark.createDataFrame(rows, "skill STRING")
    approx = [(r.label, r["count"]) for r in aggs.top_k_approx(df, "skill", 3).collect()]
    exact = [(r.skill, r["count"]) for r in aggs.top_k(df.groupBy("skill").count(), "skill", 3).collect()]
    # the third place is a 40-way tie: the sketch may name any of them, the counts must agree
    assert approx[:2] == exact[:2] and [c for _, c in approx] == [c for _, c in exact]


def test_merge_upsert_do_nothing_variant(spark):
    target = spark.createDataFrame([(1, "s", "a", "Old", True, ts("2024-01-01"))],
                                   "id INT, source STRING, source_job_id STRING, company_name STRING, is_active BOOLEAN, "
                                   "updated_at TIMESTAMP_NTZ")
    up = spark.createDataFrame([(7, "s", "a", "New", 1), (8, "s", "b", "B", 2)],
                               "id INT, source STRING, source_job_id STRING, company_name STRING, arrival INT")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    out = merge.merge_upsert(target, up, ["source", "source_job_id"], ["company_name"], "arrival", now, on_conflict="nothing")
    got = {r.source_job_id: (r.id, r.company_name, r.updated_at.year) for r in out.collect()}
    assert got == {"a": (1, "Old", 2024), "b": (8, "B", 2024)}
    assert {r.source_job_id: r.updated_at.month for r in out.collect()} == {"a": 1, "b": 2}


def test_fill_from_profile_and_toggle_saved(spark):
    df = spark.createDataFrame([(1, "", None, True), (2, "Set", "Role", False)],
                               "id INT, company_name STRING, role_title STRING, is_saved BOOLEAN")
    prof = df.withColumn("p", F.struct(F.lit("Acme").alias("company"), F.lit("Eng").alias("role_title")))
    got = {r.id: (r.company_name, r.role_title) for r in merge.fill_from_profile(
        prof, "p", {"company_name": "company", "role_title": "role_title"}).collect()}
    assert got == {1: ("Acme", "Eng"), 2: ("Set", "Role")}
    toggles = spark.createDataFrame([(1,), (1,), (1,), (2,), (2,)], "id INT")
    assert {r.id: r.is_saved for r in merge.toggle_saved(df, toggles, "id").collect()} == {1: False, 2: False}


def test_retained(spark):
    df = spark.createDataFrame([(ts("2024-01-01"),), (ts("2024-01-09"),)], "ts TIMESTAMP_NTZ")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    assert work.retained(df, "ts", now, 7).count() == 1


def test_interview_and_gap_prompts(spark):
    from talentlake.functions import text as T

    schema = ("job STRUCT<role_title: STRING, company: STRING, seniority: STRING, must_have: ARRAY<STRUCT<text: STRING>>, responsibilities: ARRAY<STRING>>, "
              "a STRUCT<fit_score: INT, ats_score: INT, gaps: ARRAY<STRUCT<missing_element: STRING, requirement: STRING>>, keywords_missing: ARRAY<STRING>>")
    gaps = [("SQL", None), (None, "Go"), (None, None), ("x1", None), ("x2", None), ("x3", None)]
    df = spark.createDataFrame([(("Dev", "Acme", None, [(f"r{i}",) for i in range(10)], ["ship"]), (70, 55, gaps, [f"k{i}" for i in range(12)])),
                                ((None, None, "senior", None, []), None)], schema)
    rows = df.select(T.render_job_interview(F.col("job")).alias("job"), T.render_gaps(F.col("a.gaps")).alias("gaps"),
                     T.render_gap_summary(F.col("a")).alias("sum")).collect()
    must = "\n".join(f"- r{i}" for i in range(8))
    assert rows[0].job == f"## Role: Dev at Acme\nSeniority: unknown\n\n**Key Requirements:**\n{must}\n\n**Responsibilities:**\n- ship\n"
    assert rows[0].gaps == "## Candidate Gaps to Address:\n- SQL\n- Go\n- \n- x1\n- x2"
    assert rows[0].sum == ("\nGap Analysis Results:\n- Fit Score: 70/100\n- ATS Score: 55/100\n- Key Gaps: SQL, x1, x2\n"
                           f"- Missing Keywords: {', '.join(f'k{i}' for i in range(10))}\n")
    assert (rows[1].job, rows[1].gaps, rows[1].sum) == ("## Role: Unknown at Unknown\nSeniority: senior\n", "", None)
