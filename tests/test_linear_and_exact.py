"""Substring joins, distributed ranks, stored sketches, linear text scans and the metadata-first file gate."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentlake.functions import text as T
from talentlake.operators import aggs, joins
from talentlake.session import scratch_path
from talentlake.sources import ingest as I


# --------------------------------------------------------------------------- C7
def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_substring_match_equals_contains(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcå ", k=rng.randint(0, 14))) for _ in range(150)] + [None, "", "100% _remote_", "a" * 40]
    targets = ["".join(rng.choices("abcå ", k=rng.randint(1, 5))) for _ in range(60)] + [None, "", "%", "_re", "zzz", "aaaa", "å", "aaz"]
    t = spark.createDataFrame([(x,) for x in texts], "t STRING").repartition(4)
    g = spark.createDataFrame([(x,) for x in targets], "g STRING")
    got = joins.substring_match(t, "t", g, "g")
    want = {(x, y) for x in texts if x is not None for y in targets if y and y in x}
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want)
    for join in ("NestedLoop", "Cartesian"):
        assert join not in plan_of(got)
    assert joins.substring_match(t, "t", g.limit(0), "g").collect() == []
    assert joins.substring_match(t.where("t = 'no'"), "t", g, "g").collect() == []


def test_preferences_are_substrings_and_hot_postings_stay_ranked(spark):
    users = spark.createDataFrame([(1, ["Java"], ["os"]), (2, [" engineer "], []), (3, ["c"], None), (4, ["", None], ["Oslo"]), (5, ["React Native"], ["Oslo", ""])],
                                  "user_id INT, target_roles ARRAY<STRING>, target_locations ARRAY<STRING>")
    posts = [(10, "JavaScript Developer", "Oslo", "onsite", True, 1), (11, "Head of Engineering", None, "Remote", True, 2), (12, "react native dev", "oslo", None, True, 3),
             (13, "Java", "Bergen", "hybrid", True, 4), (14, "Java", "Oslo", "onsite", False, 5), (15, None, "Oslo", "remote", True, 6), (16, "C", "Oslo", "remote", True, 7)]
    posts += [(100 + i, "Senior Java Engineer", "Berlin", "remote", True, 100 + i) for i in range(300)]
    frame = spark.createDataFrame(posts, "id INT, role_title STRING, location STRING, remote_policy STRING, is_active BOOLEAN, seen INT").repartition(6)
    want = set()
    for u, roles, places in ((r.user_id, r.target_roles, r.target_locations or []) for r in users.collect()):
        for p, title, place, remote, active, _ in posts:
            if active and title and any(r and r.strip() and r.strip().lower() in title.lower() for r in roles):
                if (remote or "").lower() == "remote" or any(x.strip() and place and x.strip().lower() in place.lower() for x in places):
                    want.add((u, p))
    assert {(r.user_id, r.id) for r in joins.preference_match(users, frame).collect()} == want
    top = joins.preference_match(users, frame, order=[-F.col("seen")], per_user=3)
    seen = {p[0]: p[5] for p in posts}
    best = {u: sorted((p for x, p in want if x == u), key=lambda p: (-seen[p], p))[:3] for u in {u for u, _ in want}}
    assert sorted((r.user_id, r["rank"], r.id) for r in top.collect()) == sorted((u, i, p) for u, ps in best.items() for i, p in enumerate(ps, 1))


# --------------------------------------------------------------------------- D17
def test_quantiles_of_one_group_are_spread_over_tasks(spark):
    n = 200_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).cast("int").alias("salary_min"), F.lit(None).cast("int").alias("salary_max"))
    got = aggs.salary_insight(rows, by=[]).collect()
    assert [(r.postings, r.with_salary, r.min_mid, r.p25_mid, r.median_mid, r.p75_mid, r.max_mid) for r in got] == [
        (n, n, 0.0, *[round(float(np.quantile(np.arange(n), q)), 2) for q in (.25, .5, .75)], n - 1.0)]
    counts = rows.select(F.col("salary_min").alias("v"), F.lit(1).cast("long").alias("n")).withColumn("g", F.lit("a"))
    ranked = aggs.rank_values(counts, ["g"], "v", "n", 8, "upto")
    assert ranked.where("upto <> v + 1").count() == 0
    windows = [line for line in plan_of(ranked).splitlines() if "Window [" in line]
    assert windows and all("_range" in line for line in windows)


def test_ranks_with_ties_nulls_and_small_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(v), int(n)) for g in ("a", None, "c") for v, n in zip(rng.permutation(30)[:(30 if g else 1)], rng.integers(1, 9, 30))]
    got = aggs.rank_values(spark.createDataFrame(rows, "g STRING, v DOUBLE, n LONG"), ["g"], "v", "n", 5, "upto").collect()
    for r in got:
        assert r.upto == sum(n for g, v, n in rows if g == r.g and v <= r.v)
    assert len(got) == len(rows)
    empty = aggs.salary_insight(spark.createDataFrame([], "g STRING, salary_min INT, salary_max INT"), "g")
    assert empty.collect() == []
    assert [(r.postings, r.median_mid) for r in aggs.salary_insight(spark.createDataFrame([("x", None, None)], "g STRING, salary_min INT, salary_max INT"), [])
            .collect()] == [(1, None)]


# --------------------------------------------------------------------------- D16 / E7
def test_a_new_day_costs_a_day_and_a_repeated_day_replaces(spark):
    rows = [(d, f"s{(i * i) % 7}", i + 1000 * d, f"c{i % 40}") for d in range(1, 6) for i in range(300)]
    frame = spark.createDataFrame(rows, "day INT, skill STRING, posting_id INT, company STRING")
    kept = aggs.DemandSketches(spark, scratch_path(spark, "t-demand"))
    for d in (1, 2, 3, 2, 4, 5, 4):
        kept.add(frame.where(F.col("day") == d), period="day")
    for where, days in ((None, range(1, 6)), (F.col("period").isin(2, 5), (2, 5))):
        mine = [r for r in rows if r[0] in days]
        got = {r.skill: (r.postings, r.companies) for r in kept.demand(where).collect()}
        assert set(got) == {r[1] for r in mine}
        for skill, (postings, companies) in got.items():
            p, c = len({r[2] for r in mine if r[1] == skill}), len({r[3] for r in mine if r[1] == skill})
            assert abs(postings - p) <= 4 * 1.04 / 64 * p + 1 and abs(companies - c) <= 4 * 1.04 / 64 * c + 1
        counts = sorted((sum(r[1] == s for r in mine) for s in got), reverse=True)
        assert sorted((r["count"] for r in kept.top(3, where).collect()), reverse=True) == counts[:3]


# --------------------------------------------------------------------------- T12
def restarting_scan(s):
    """First balanced {...}: every brace is tried in turn by a scan of its own."""
    start = s.find("{")
    while start != -1:
        depth, in_str, esc = 0, False, False
        for i in range(start, len(s)):
            ch = s[i]
            if in_str:
                if esc:
                    esc = False
                elif ch == "\\":
                    esc = True
                elif ch == '"':
                    in_str = False
            elif ch == '"':
                in_str = True
            elif ch == "{":
                depth += 1
            elif ch == "}":
                depth -= 1
                if depth == 0:
                    return s[start:i + 1]
        start = s.find("{", start + 1)
    return None


def test_one_pass_scan_equals_restarting_scans():
    rng = random.Random(2)
    for n in range(40_000):
        s = "".join(rng.choices('{}"\\a', (3, 2, 2, 2, 1), k=rng.randint(0, 18)))
        assert T._balanced(s) == restarting_scan(s), s
    assert T._balanced(None) is None and T._balanced('x {"a": "}"} y') == '{"a": "}"}'


@pytest.mark.parametrize("piece", ["{", '{"', '{"a\\"', "}{{", '{"x":"\\\\"{'])
def test_scan_is_linear(piece):
    def seconds(n):
        text = piece * n
        best = 9.0
        for _ in range(3):
            t = time.perf_counter()
            T._balanced(text)
            best = min(best, time.perf_counter() - t)
        return best

    small, large = seconds(20_000), seconds(160_000)
    assert large < 8 * small * 3 + 0.05


# --------------------------------------------------------------------------- T7
def test_sections_are_linear_and_take_the_last_heading(spark):
    def document(n):
        return "\n".join(f"SKILLS {i}\n- item {i}\n====\nplain" for i in range(n // 4))

    def seconds(n):
        df = spark.createDataFrame([(1, document(n))], "doc_id INT, text STRING")
        T.sections(df).count()
        t = time.perf_counter()
        rows = T.sections(df).agg(F.count("*"), F.sum(F.expr("CASE WHEN heading = 'SKILLS ' || substring(item, 6) THEN 1 END"))).first()
        assert tuple(rows) == (n // 4, n // 4)
        return time.perf_counter() - t

    seconds(4_000)
    assert seconds(200_000) < 20
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "- lost\nMUST HAVE\nNICE TO HAVE\n- a\n- b\n\nOther:\n- c\nSkills:"), (4, "Skills:\n- x 3+ years")],
                                "doc_id INT, text STRING")
    assert sorted(map(tuple, T.sections(odd).collect())) == [(3, 3, "nice_to_have", "NICE TO HAVE", "a", None), (3, 4, "nice_to_have", "NICE TO HAVE", "b", None),
                                                            (4, 1, "skills", "Skills:", "x 3+ years", 3)]


# --------------------------------------------------------------------------- T11
def test_technologies_line(spark):
    cv = "STRUCT<name: STRING, summary: STRING, total_years_experience: INT, skills: ARRAY<STRUCT<name: STRING, proficiency: STRING, years: INT>>, " \
         "experience: ARRAY<STRUCT<company: STRING, role: STRING, start_date: STRING, end_date: STRING, highlights: ARRAY<STRING>, technologies: ARRAY<STRING>>>, " \
         "education: ARRAY<STRUCT<degree: STRING, field: STRING, institution: STRING>>, certifications: ARRAY<STRING>>"
    jobs = [("Co", "Dev", "2020", None, ["built it"], ["Go", "SQL"]), ("Old", "Ops", "2018", "2020", [], []), ("Older", "QA", "2017", "2018", None, None)]
    df = spark.createDataFrame([(("Ann", None, None, [], jobs, None, None),)], f"p {cv}")
    assert df.select(T.render_cv(F.col("p"))).first()[0] == (
        "## Candidate: Ann\n\n**Work Experience:**\n\n### Dev at Co (2020 - Present)\n  - built it\n  Technologies: Go, SQL\n"
        "\n### Ops at Old (2018 - 2020)\n\n### QA at Older (2017 - 2018)\n")


# --------------------------------------------------------------------------- A4
def test_files_beyond_the_bound_are_not_opened(spark, tmp_path):
    for name, content in {"good.pdf": b"%PDF-1.4 " + b"x" * 200, "tiny.pdf": b"%PDF", "other.pdf": b"PK\x03\x04" + b"x" * 200, "empty.pdf": b"", "note.txt": b"%PDF" * 99}.items():
        (tmp_path / name).write_bytes(content)
    with open(tmp_path / "huge.pdf", "wb") as f:
        f.write(b"%PDF")
        f.truncate(3 << 30)  # sparse: Spark could not read it into one value
    got = {r.path.rsplit("/", 1)[1]: r for r in I.gate_files(spark, str(tmp_path)).collect()}
    assert {n: (r.admitted, r.reject_reason) for n, r in got.items()} == {
        "good.pdf": (True, None), "tiny.pdf": (False, "too_small"), "other.pdf": (False, "not_pdf"), "huge.pdf": (False, "too_large")}
    assert got["huge.pdf"].length == 3 << 30
    assert {n for n, r in got.items() if r.content is not None} == {"good.pdf"} and isinstance(got["good.pdf"].modificationTime, dt.datetime)
