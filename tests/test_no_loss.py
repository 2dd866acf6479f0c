"""Rows that operators once dropped or merged: long targets, far neighbours, many recommendations, late events, timers."""

import datetime as dt
import time

import numpy as np
from pyspark.sql import functions as F

from talentlake.operators import aggs, joins, ranking
from talentlake.operators import vector_store as VS
from talentlake.operators import vectors as VX
from talentlake.session import scratch_path
from talentlake.streaming import streams as S
from talentlake.streaming import tables as TB


def test_preference_match_long_targets_and_top_n(spark):
    title = "senior staff machine learning platform engineer"
    users = spark.createDataFrame([(1, [title], ["New York City Metro Area East"]), (2, ["engineer"], ["Oslo"])],
                                  "user_id INT, target_roles ARRAY<STRING>, target_locations ARRAY<STRING>")
    posts = spark.createDataFrame([(10, title.title(), "New York City Metro Area East", "onsite", True, 5),
                                   (11, "Engineer", "Bergen", "remote", True, 9), (12, "engineer", "oslo", "onsite", True, 7),
                                   (13, "engineer", "Oslo", "onsite", False, 8)],
                                  "id INT, role_title STRING, location STRING, remote_policy STRING, is_active BOOLEAN, seen INT")
    got = sorted((r.user_id, r.id) for r in joins.preference_match(users, posts).collect())
    assert got == [(1, 10), (2, 11), (2, 12)]
    top = joins.preference_match(users, posts, order=[-F.col("seen")], per_user=1).collect()
    assert sorted((r.user_id, r.id, r["rank"]) for r in top) == [(1, 10, 1), (2, 11, 1)]


def test_knn_approx_fills_up_and_skips_faulty_vectors(spark):
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, None), (5, [1.0])],
                                 "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    qs = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "query_id INT, query ARRAY<DOUBLE>")
    for out in (VS.knn_approx(qs, vecs.where("vec_id <= 3"), 3), VX.knn(qs, vecs, 3)):
        assert [(r.query_id, r.vec_id) for r in out.orderBy("rank").collect()] == [(0, 1), (0, 2), (0, 3)]
    assert {r.vec_id: r.reason for r in VX.vector_faults(vecs, 2).collect()} == {4: "no vector", 5: "wrong length"}


def test_knn_grid_equals_one_cell(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(200, 8)))], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(30, 8)))], "query_id INT, query ARRAY<DOUBLE>")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(VX.knn(q, v, 5)) == rows(VX.knn(q, v, 5, cell_vectors=30, cell_queries=7))


def test_all_recommendations_stay(spark):
    gaps = spark.createDataFrame([(i, "sql", "high", f"learn {i % 9}") for i in range(18)] + [(99, "go", None, None)],
                                 "app_id INT, missing_element STRING, severity STRING, recommendation STRING").withColumn("requirement", F.lit(None).cast("string"))
    got = aggs.skill_gap_profile(gaps).collect()
    assert sorted((r.skill, r.recommendation, r.recommendation_count) for r in got if r.skill == "sql") == [("sql", f"learn {i}", 2) for i in range(9)]
    assert [(r.frequency, r.recommendation, r.recommendation_count) for r in got if r.skill == "go"] == [(1, None, 0)]


def test_dedupe_key_company_only_and_case(spark):
    df = spark.createDataFrame([(1, "", None, "Acme"), (2, None, "Dev", "acme"), (3, "", "dev", "acme"), (4, "", "", ""), (5, None, None, "Acme")],
                               "id INT, source_job_id STRING, role_title STRING, company_name STRING")
    got = ranking.dedupe_first(df, ranking.dedupe_key(), ["id"]).collect()
    assert sorted(r.id for r in got) == [1, 2, 3]


def test_dedupe_with_late_loses_nothing(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    m = lambda k: t0 + dt.timedelta(minutes=k)
    src = str(tmp_path / "in")
    for rows in ([(1, m(0)), (2, m(60))], [(2, m(60)), (3, m(55)), (4, m(200))], [(1, m(0)), (7, m(5)), (8, m(300)), (9, None)], [(7, m(5)), (8, m(300))]):
        spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP_NTZ").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    s = spark.readStream.schema("event_id BIGINT, ts TIMESTAMP_NTZ").option("maxFilesPerTrigger", 1).parquet(src)
    path = S.dedupe_with_late(s, "event_id", scratch_path(spark, "t-late"))
    main, late = ([r.event_id for r in spark.read.parquet(f"{path}/{n}").collect()] for n in ("main", "late"))
    assert sorted(main) == [1, 2, 3, 4, 8] and sorted(late) == [7, 9]


def test_salary_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(x), int(x) + 10) for g in "ab" for x in rng.integers(0, 40, 57)] + [("c", None, None), (None, 5, None)]
    df = spark.createDataFrame(rows, "loc STRING, salary_min INT, salary_max INT")
    got = {r["loc"]: r for r in aggs.salary_insight(df, "loc").collect()}
    for g in "ab":
        mids = [(lo + hi) / 2 for k, lo, hi in rows if k == g]
        assert [got[g].p25_mid, got[g].median_mid, got[g].p75_mid] == [round(float(np.quantile(mids, q)), 2) for q in (.25, .5, .75)]
    assert (got["c"].with_salary, got["c"].median_mid, got[None].median_mid) == (0, None, 5.0)


def test_changelog_is_compacted_and_shrinks(spark, tmp_path):
    src, out = str(tmp_path / "in"), scratch_path(spark, "t-log")
    for i in range(7):
        spark.createDataFrame([(k, 1) for k in range(i, i + 3)], "k INT, n INT").coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    s = spark.readStream.schema("k INT, n INT").option("maxFilesPerTrigger", 1).parquet(src)
    counts = s.groupBy("k").agg(F.sum("n").alias("n"))
    S.write_changelog(counts, "t", ["k"], path=out, compact_every=2)
    got = {r.k: r.n for r in S.compact_changelog(spark, out, ["k"], counts.schema).collect()}
    assert got == {k: min(k + 1, 3, 9 - k) for k in range(9)}
    # bases at batches 1, 3, 5; the last one kept the base before it and the batches after that
    assert sorted(TB.bases(spark, out)) == [3, 5]
    assert sorted(TB.folders(spark, f"{out}/log", "_batch")) == [4, 5, 6]
