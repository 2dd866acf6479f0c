"""D: aggregations over applications, gaps, postings, findings and sessions.

All operators are declarative ``groupBy``/``agg`` plans, so Spark runs a
partial (map-side) aggregate before the shuffle: a hot user or status adds one
row per map partition to the exchange, never its raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentlake.session import scratch_path

# Pipeline stages of the application funnel.
APPLIED_STAGE = ["applied", "screening"]
INTERVIEW_STAGE = ["phone_screen", "interview", "technical", "onsite"]
OFFER_STAGE = ["offer", "accepted"]
# Severity order, low=1 ... critical=4.
SEVERITY_ORDER = ["low", "medium", "high", "critical"]


def _by(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _pct(num: Column, den: Column, digits: int = 1) -> Column:
    """``round(num / den * 100, digits)``; NULL when the denominator is 0."""
    return F.round(F.try_divide(num * F.lit(100.0), den), digits)


def severity_rank(col: Column | str) -> Column:
    """T14: severity label → ordinal (low=1 … critical=4), NULL for other values."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for i, label in enumerate(SEVERITY_ORDER, start=1):
        expr = F.when(c == label, F.lit(i)) if expr is None else expr.when(c == label, F.lit(i))
    return expr


def severity_label(rank: Column) -> Column:
    """Ordinal → label (inverse of ``severity_rank``)."""
    expr = None
    for i, label in enumerate(SEVERITY_ORDER, start=1):
        expr = F.when(rank == i, F.lit(label)) if expr is None else expr.when(rank == i, F.lit(label))
    return expr


# --------------------------------------------------------------------------- D1
def pipeline_stats(apps: DataFrame, user: str = "user_id", status: str = "status", ts: str = "created_at") -> DataFrame:
    """Per (user, status): count, earliest and latest creation time."""
    return apps.groupBy(user, status).agg(
        F.count(F.lit(1)).alias("count"),
        F.min(ts).alias("earliest"),
        F.max(ts).alias("latest"),
    )


# --------------------------------------------------------------------------- D2
def status_breakdown(apps: DataFrame, by: str | Sequence[str] | None = None, status: str = "status") -> DataFrame:
    """Count and share (1 decimal) per status; a missing status counts as 'unknown'.

    The share needs the group total: it is taken from a window over the already
    aggregated rows (one row per status), never over raw applications.
    """
    keys = _by(by)
    counted = apps.groupBy(*keys, F.coalesce(F.col(status), F.lit("unknown")).alias("status")).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = F.sum("count").over(Window.partitionBy(*keys) if keys else Window.partitionBy())
    return counted.select(*keys, "status", "count", F.coalesce(_pct(F.col("count"), total), F.lit(0.0)).alias("pct"))


# --------------------------------------------------------------------------- D3
def stage_funnel(apps: DataFrame, by: str | Sequence[str] | None = None, status: str = "status") -> DataFrame:
    """Current-stage funnel with response and offer rates (NULL on a zero denominator)."""
    s = F.col(status)
    applied = F.count_if(s.isin(APPLIED_STAGE))
    interview = F.count_if(s.isin(INTERVIEW_STAGE))
    offer = F.count_if(s.isin(OFFER_STAGE))
    agg = apps.groupBy(*_by(by)).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "saved").alias("saved"),
        applied.alias("applied"),
        interview.alias("interview"),
        offer.alias("offer"),
    )
    return agg.withColumn("response_rate", _pct(F.col("interview"), F.col("applied"))).withColumn(
        "offer_rate", _pct(F.col("offer"), F.col("interview"))
    )


# --------------------------------------------------------------------------- D4
def application_funnel(apps: DataFrame, by: str | Sequence[str] | None = None, status: str = "status",
                       applied_at: str = "applied_at", response_date: str = "response_date") -> DataFrame:
    """Cumulative funnel (declared metrics): every later stage counts as having passed the earlier ones."""
    s = F.col(status)
    agg = apps.groupBy(*_by(by)).agg(
        F.count(F.lit(1)).alias("total_saved"),
        F.count(applied_at).alias("total_applied"),
        F.count(response_date).alias("total_responses"),
        F.count_if(s.isin(INTERVIEW_STAGE + OFFER_STAGE)).alias("total_interviews"),
        F.count_if(s.isin(OFFER_STAGE)).alias("total_offers"),
    )
    return (
        agg.withColumn("response_rate", _pct(F.col("total_responses"), F.col("total_applied")))
        .withColumn("interview_rate", _pct(F.col("total_interviews"), F.col("total_applied")))
        .withColumn("offer_rate", _pct(F.col("total_offers"), F.col("total_interviews")))
    )


# --------------------------------------------------------------------------- D5a / E7
def top_k(counts: DataFrame, label: str, k: int, count: str = "count") -> DataFrame:
    """Top-k labels by count desc, label asc (``TakeOrderedAndProject``: k rows per partition)."""
    if k < 0:
        raise ValueError("k must be >= 0")
    return counts.orderBy(F.col(count).desc(), F.col(label).asc_nulls_last()).limit(k)


def top_k_approx(df: DataFrame, label: str | Column, k: int, max_items: int = 10000) -> DataFrame:
    """Sketch form of top-k (``approx_top_k``): one pass, bounded memory per task, mergeable
    partial sketches — no shuffle of raw rows however skewed the labels are."""
    lab = F.col(label) if isinstance(label, str) else label
    top = df.agg(F.call_function("approx_top_k", lab, F.lit(k), F.lit(max_items)).alias("top"))
    return top.select(F.inline("top")).withColumnsRenamed({"item": "label"})


def gap_frequency(gaps: DataFrame, k: int = 10, missing: str = "missing_element",
                  requirement: str = "requirement") -> DataFrame:
    """Gap label = missing element, else requirement, else 'Unknown'; count; top k."""
    label = F.coalesce(F.col(missing), F.col(requirement), F.lit("Unknown")).alias("skill")
    counts = gaps.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return top_k(counts, "skill", k)


def explode_gaps(apps: DataFrame, gaps_col: str = "gaps") -> DataFrame:
    """Nested form: one row per gap struct (``explode_outer`` keeps apps without gaps out of counts)."""
    return apps.select("*", F.explode(gaps_col).alias("_gap")).select("*", "_gap.*").drop("_gap", gaps_col)


# --------------------------------------------------------------------------- D5b
def skill_gap_profile(gaps: DataFrame, job: str = "app_id", skill: Column | None = None,
                      severity: str = "severity", recommendation: str = "recommendation") -> DataFrame:
    """Per skill: distinct jobs, mean severity rounded back to a label, and all its recommendations.

    One row for each (skill, recommendation) with its count, so no array grows with the number of
    distinct texts; a skill without recommendation has one row with NULL and 0.
    """
    skill = skill if skill is not None else F.coalesce(F.col("missing_element"), F.col("requirement"), F.lit("Unknown"))
    g = gaps.select(skill.alias("skill"), F.col(job).alias("_job"), F.col(severity).alias("_sev"),
                    F.col(recommendation).alias("_rec"))
    agg = g.groupBy("skill").agg(
        F.count_distinct("_job").alias("frequency"),
        F.avg(severity_rank(F.col("_sev"))).alias("_sev"),
    )
    recs = g.where(F.col("_rec").isNotNull()).groupBy("skill", "_rec").agg(F.count(F.lit(1)).alias("_n"))
    return agg.join(recs, "skill", "left").select(
        "skill", "frequency",
        severity_label(F.round("_sev", 0).cast("int")).alias("average_severity"),
        F.col("_rec").alias("recommendation"), F.coalesce("_n", F.lit(0)).alias("recommendation_count"),
    )


# --------------------------------------------------------------------------- D6
def role_breakdown(apps: DataFrame, k: int = 8, role: str = "role_title", nested_role: str | None = None) -> DataFrame:
    """Count per role (fallback nested job role, then 'Unknown'), top k."""
    parts = [F.col(role)] + ([F.col(nested_role)] if nested_role else []) + [F.lit("Unknown")]
    counts = apps.groupBy(F.coalesce(*parts).alias("role")).agg(F.count(F.lit(1)).alias("count"))
    return top_k(counts, "role", k)


# --------------------------------------------------------------------------- D7
def avg_fit(apps: DataFrame, by: str | Sequence[str] | None = None, score: str = "fit_score") -> DataFrame:
    """Mean fit score with 0 and NULL excluded (the reference's falsy test), 1 decimal."""
    return apps.groupBy(*_by(by)).agg(
        F.round(F.avg(F.nullif(F.col(score), F.lit(0))), 1).alias("avg_fit"),
        F.count(F.nullif(F.col(score), F.lit(0))).alias("scored"),
    )


# --------------------------------------------------------------------------- D8
# Fit-score band schemes (lower bounds, descending) and their labels.
FIT_BANDS = {
    "chart": [(90, "90-100"), (75, "75-89"), (60, "60-74"), (0, "Below 60")],
    "prompt": [(90, "Excellent"), (75, "Strong"), (60, "Moderate"), (40, "Partial"), (0, "Poor")],
    "ui": [(80, "Excellent"), (60, "Good"), (40, "Fair"), (0, "Poor")],
}


def fit_band(score: Column, scheme: str = "chart") -> Column:
    bands = FIT_BANDS[scheme]
    expr = None
    for lower, label in bands[:-1]:
        expr = F.when(score >= lower, F.lit(label)) if expr is None else expr.when(score >= lower, F.lit(label))
    return expr.otherwise(F.lit(bands[-1][1]))


def fit_bands(df: DataFrame, scheme: str = "chart", score: str = "fit_score") -> DataFrame:
    """Histogram over named bands; empty bands shown with 0 (band dimension left join)."""
    spark = df.sparkSession
    bands = FIT_BANDS[scheme]
    dim = spark.createDataFrame([(i, label) for i, (_, label) in enumerate(bands)], "band_order INT, band STRING")
    counts = (
        df.where(F.col(score).isNotNull())
        .groupBy(fit_band(F.col(score), scheme).alias("band"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # the band dimension has len(bands) rows: broadcasting it is size-bounded
    return F.broadcast(dim).join(counts, "band", "left").select(
        "band_order", "band", F.coalesce(F.col("count"), F.lit(0)).alias("count")
    )


# --------------------------------------------------------------------------- D9
def dashboard_kpis(users: DataFrame, cv: DataFrame, jobs: DataFrame, analyses: DataFrame,
                   user_key: str = "user_id", user: str = "user_id", job_key: str = "id",
                   analysis_job: str = "job_id", score: str = "fit_score") -> DataFrame:
    """Per user: cv / job / analysis counts and mean fit (NULL when there is none or it is 0).

    Analyses belong to the user of their posting (inner join on the job).  Each
    fact is aggregated to one row per user *before* the joins to the user
    table, so those joins are 1:1 and nothing fans out.
    """
    cv_n = cv.groupBy(F.col(user).alias("_u")).agg(F.count(F.lit(1)).alias("cv_count"))
    job_n = jobs.groupBy(F.col(user).alias("_u")).agg(F.count(F.lit(1)).alias("job_count"))
    owner = jobs.select(F.col(job_key).alias("_j"), F.col(user).alias("_u"))
    an = (
        analyses.select(F.col(analysis_job).alias("_j"), F.col(score).alias("_s"))
        .join(owner, "_j")
        .groupBy("_u")
        .agg(F.count(F.lit(1)).alias("analysis_count"), F.avg("_s").alias("_fit"))
    )
    base = users.select(F.col(user_key).alias("_u"))
    out = base.join(cv_n, "_u", "left").join(job_n, "_u", "left").join(an, "_u", "left")
    return out.select(
        F.col("_u").alias(user_key),
        F.coalesce("cv_count", F.lit(0)).alias("cv_count"),
        F.coalesce("job_count", F.lit(0)).alias("job_count"),
        F.coalesce("analysis_count", F.lit(0)).alias("analysis_count"),
        # the reference rounds in Python (half-even) and treats an average of 0 as missing
        F.when(F.col("_fit") != 0, F.bround("_fit", 1)).alias("avg_fit"),
    )


# --------------------------------------------------------------------------- D10
def insight_summary(findings: DataFrame, category: str = "category") -> DataFrame:
    """Total and count per category in one pass (grouping sets (category), ())."""
    return (
        findings.groupingSets([[category], []], category)
        .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("level"))
        .select(F.when(F.col("level") == 1, F.lit("total")).otherwise(F.col(category)).alias(category),
                "count", "level")
    )


# --------------------------------------------------------------------------- D11
def source_summary(disc: DataFrame, source: str = "source", active: str = "is_active",
                   ts: str = "discovered_at") -> DataFrame:
    """Active postings: count and latest discovery per source plus the total row (rollup)."""
    return (
        disc.where(F.col(active))
        .rollup(F.lower(F.col(source)).alias("source"))
        .agg(F.count(F.lit(1)).alias("count"), F.max(ts).alias("latest_discovery"),
             F.grouping_id().alias("level"))
    )


# --------------------------------------------------------------------------- D12
def response_rates(apps: DataFrame, dim: str, min_n: int = 1, response: str = "response_date") -> DataFrame:
    """Response % per dimension value (role, company, CV version...), groups below ``min_n`` dropped."""
    return (
        apps.groupBy(dim)
        .agg(F.count(F.lit(1)).alias("n"), F.count(response).alias("responses"))
        .where(F.col("n") >= min_n)
        .withColumn("response_rate", _pct(F.col("responses"), F.col("n")))
    )


def top_by_response(apps: DataFrame, dim: str, k: int, min_n: int = 1, response: str = "response_date") -> DataFrame:
    """Top-k dimension values by response rate (ties: more applications, then name)."""
    rates = response_rates(apps, dim, min_n, response)
    return rates.orderBy(F.col("response_rate").desc(), F.col("n").desc(), F.col(dim).asc()).limit(k)


def best_by_response(apps: DataFrame, dim: str, by: str | None = None, min_n: int = 1,
                     response: str = "response_date") -> DataFrame:
    """Best performing value of ``dim`` (per ``by``): highest response rate, ties by count then name."""
    keys = _by(by)
    rates = (
        apps.groupBy(*keys, dim)
        .agg(F.count(F.lit(1)).alias("n"), F.count(response).alias("responses"))
        .where(F.col("n") >= min_n)
        .withColumn("response_rate", _pct(F.col("responses"), F.col("n")))
    )
    w = Window.partitionBy(*keys).orderBy(F.col("response_rate").desc(), F.col("n").desc(), F.col(dim).asc())
    return rates.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# --------------------------------------------------------------------------- D13
# Day buckets of the response-time histogram (upper bounds, inclusive).
RESPONSE_BUCKETS = [(7, "0-7"), (14, "8-14"), (30, "15-30")]


def response_days(apps: DataFrame, applied_at: str = "applied_at", response: str = "response_date") -> Column:
    return F.datediff(F.col(response), F.col(applied_at))


def time_to_response(apps: DataFrame, by: str | Sequence[str] | None = None, applied_at: str = "applied_at",
                     response: str = "response_date") -> DataFrame:
    """Mean, p50 and p90 (exact) days from application to response."""
    d = response_days(apps, applied_at, response)
    return (
        apps.where(F.col(applied_at).isNotNull() & F.col(response).isNotNull())
        .groupBy(*_by(by))
        .agg(
            F.count(F.lit(1)).alias("responses"),
            F.round(F.avg(d), 2).alias("avg_days"),
            F.round(F.percentile(d, F.lit(0.5)), 2).alias("p50_days"),
            F.round(F.percentile(d, F.lit(0.9)), 2).alias("p90_days"),
        )
    )


def response_histogram(apps: DataFrame, applied_at: str = "applied_at", response: str = "response_date") -> DataFrame:
    d = response_days(apps, applied_at, response)
    bucket = None
    for upper, label in RESPONSE_BUCKETS:
        bucket = F.when(d <= upper, F.lit(label)) if bucket is None else bucket.when(d <= upper, F.lit(label))
    bucket = bucket.otherwise(F.lit("30+"))
    return (
        apps.where(F.col(applied_at).isNotNull() & F.col(response).isNotNull())
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


# --------------------------------------------------------------------------- D14
def application_trend(apps: DataFrame, grain: str = "month", ts: str = "created_at") -> DataFrame:
    """Applications per period, zero-filled between the first and last period.

    The calendar is generated from the min/max of the data (one row per
    period, so its size grows with the time span, not with the rows) and is
    left-joined to the counts.
    """
    period = F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz")
    counts = apps.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("count"))
    step = F.expr(f"INTERVAL 1 {grain.upper()}")
    calendar = counts.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", step)).alias("period")
    )
    return calendar.join(counts, "period", "left").select(
        "period", F.coalesce("count", F.lit(0)).alias("count")
    )


# --------------------------------------------------------------------------- D15
def session_scores(evals: DataFrame, session: str = "session_id", score: str = "score",
                   clarity: str = "clarity", relevance: str = "relevance", depth: str = "depth",
                   star: str = "star_method_used") -> DataFrame:
    """Per session: mean scores (1..5), STAR share over non-NULL answers, overall = 20·mean score."""
    return evals.groupBy(session).agg(
        F.count(F.lit(1)).alias("answers"),
        F.round(F.avg(score), 2).alias("avg_score"),
        F.round(F.avg(clarity), 2).alias("avg_clarity"),
        F.round(F.avg(relevance), 2).alias("avg_relevance"),
        F.round(F.avg(depth), 2).alias("avg_depth"),
        F.round(F.avg(F.col(star).cast("int")), 3).alias("star_share"),
        F.round(F.avg(score) * 20).cast("int").alias("overall_score"),
    )


# --------------------------------------------------------------------------- D16
def skill_demand(posting_skills: DataFrame, skill: str = "skill", posting: str = "posting_id",
                 company: str = "company") -> DataFrame:
    """Postings and companies per skill and share of all postings (exact distinct counts)."""
    total = posting_skills.agg(F.count_distinct(posting)).scalar()
    per = posting_skills.groupBy(skill).agg(
        F.count_distinct(posting).alias("postings"),
        F.count_distinct(company).alias("companies"),
    )
    return per.select(skill, "postings", "companies", _pct(F.col("postings"), total, 2).alias("share"))


def skill_demand_approx(posting_skills: DataFrame, skill: str = "skill", posting: str = "posting_id",
                        company: str = "company", rsd: float = 0.02) -> DataFrame:
    """HyperLogLog form: bounded state per skill whatever the number of postings."""
    return posting_skills.groupBy(skill).agg(
        F.approx_count_distinct(posting, rsd).alias("postings"),
        F.approx_count_distinct(company, rsd).alias("companies"),
    )


class DemandSketches:
    """Skill demand kept as mergeable sketches per period under ``path``: a new period costs that period.

    Per (period, skill) two HyperLogLog sketches, of postings and of companies (2^``lg_k`` registers: about
    1.04 / sqrt(2^lg_k) relative error), and per period one top-k sketch of the skills.  A period that is added
    again replaces its sketches.
    """

    def __init__(self, spark: SparkSession, path: str, lg_k: int = 12, tracked: int = 10_000):
        self.spark, self.path, self.lg_k, self.tracked = spark, path, lg_k, tracked

    def add(self, rows: DataFrame, period: str = "period", skill: str = "skill", posting: str = "posting_id",
            company: str = "company") -> None:
        """Add all periods that ``rows`` has (partial aggregation: a hot skill sends a sketch per task)."""
        rows = rows.withColumnRenamed(period, "period")
        per = rows.groupBy("period", F.col(skill).alias("skill")).agg(
            F.hll_sketch_agg(posting, self.lg_k).alias("postings"), F.hll_sketch_agg(company, self.lg_k).alias("companies"))
        self._write(per, "demand")
        self._write(rows.groupBy("period").agg(F.expr(f"approx_top_k_accumulate(`{skill}`, {self.tracked})").alias("skills")), "top")

    def _write(self, sketches: DataFrame, name: str) -> None:
        (sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(f"{self.path}/{name}"))

    def _read(self, name: str, where: Column | None) -> DataFrame:
        got = self.spark.read.parquet(f"{self.path}/{name}")
        return got if where is None else got.where(where)

    def demand(self, where: Column | None = None) -> DataFrame:
        """skill, postings, companies (approximate distinct counts) over the periods that ``where`` keeps."""
        return self._read("demand", where).groupBy("skill").agg(
            F.hll_sketch_estimate(F.hll_union_agg("postings")).alias("postings"),
            F.hll_sketch_estimate(F.hll_union_agg("companies")).alias("companies"))

    def top(self, k: int, where: Column | None = None) -> DataFrame:
        """skill, count: the k most frequent skills over the periods that ``where`` keeps."""
        all_of = self._read("top", where).agg(F.expr(f"approx_top_k_combine(skills, {self.tracked})").alias("s"))
        return all_of.select(F.explode(F.expr(f"approx_top_k_estimate(s, {k})")).alias("t")).select(
            F.col("t.item").alias("skill"), F.col("t.count").alias("count"))


# --------------------------------------------------------------------------- D17
def rank_values(counts: DataFrame, by: Sequence[str], value: str, n: str, parts: int, out: str) -> DataFrame:
    """``counts`` (one row per group and value) with ``out``: how many rows of its group are up to the value.

    The values are cut into ``parts`` ranges at quantiles of all rows of ``counts`` (a sketch, so ranges are
    only about even; the ranks are exact).  A range's rows are summed up in order by one task, and what lies in
    the ranges before comes from one sum per (group, range): a group with most of the values is spread over all
    ranges, and no task holds more than a range of a group.
    """
    cuts = [i / parts for i in range(1, parts)]
    bounds = counts.agg(F.percentile_approx(value, cuts, 10_000)).first()[0] if cuts else None
    at = F.lit(0) if not bounds else F.size(F.filter(F.array(*[F.lit(b) for b in dict.fromkeys(bounds)]), lambda b: b < F.col(value)))
    ranged = counts.withColumn("_range", at)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*by, "_range").agg(F.sum(n).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    inside = F.sum(n).over(Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    names = {c: f"_o_{c}" for c in (*by, "_range")}
    same = _all([F.col(c).eqNullSafe(F.col(o)) for c, o in names.items()])
    joined = ranged.withColumn("_in", inside).join(offsets.drop("_sum").withColumnsRenamed(names), same)
    return joined.select(*counts.columns, (F.col("_in") + F.col("_before")).alias(out))


def salary_insight(postings: DataFrame, by: str | Sequence[str], lo: str = "salary_min", hi: str = "salary_max") -> DataFrame:
    """Salary midpoint stats per group (``by=[]``: of all postings); NULL salaries left out, coverage % shown.

    Midpoint = (min + max) / 2, or the one known bound.  Quantiles are exact and interpolated: the midpoints
    are counted per (group, value), written once, ranked in ranges (``rank_values``), and the values at the two
    ranks around each quantile are read off, so no task holds all values of a group at once.
    """
    spark = postings.sparkSession
    keys = _by(by)
    mid = F.when(F.col(lo).isNotNull() & F.col(hi).isNotNull(), (F.col(lo) + F.col(hi)) / 2.0).otherwise(
        F.coalesce(F.col(lo), F.col(hi)).cast("double")
    )
    values = postings.select(*keys, mid.alias("_mid"))
    names = values.columns[:-1]
    path = scratch_path(spark, "salary-counts")
    values.groupBy(*names, "_mid").agg(F.count(F.lit(1)).alias("_n")).write.parquet(path)
    counts = spark.read.parquet(path)
    known = F.col("_mid").isNotNull()
    totals = counts.groupBy(*names).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("postings"),
        F.coalesce(F.sum(F.when(known, F.col("_n"))), F.lit(0)).alias("with_salary"),
        F.min("_mid").alias("min_mid"), F.max("_mid").alias("max_mid"),
        (F.sum(F.col("_mid") * F.col("_n")) / F.sum(F.when(known, F.col("_n")))).alias("_avg"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    same = _all([F.lit(True), *[F.col(n).eqNullSafe(F.col(f"_g_{n}")) for n in names]])
    n_known = totals.select(*[F.col(n).alias(f"_g_{n}") for n in names], "with_salary")
    ranked = rank_values(counts.where(known), names, "_mid", "_n", parts, "_upto").join(n_known, same)
    at = {}
    for q in (25, 50, 75):
        pos = (F.col("with_salary") - 1) * (q / 100)
        for side, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            at[f"_{side}{q}"] = F.min(F.when(F.col("_upto") > rank, F.col("_mid")))
    picked = ranked.groupBy(*names).agg(*[c.alias(n) for n, c in at.items()])
    picked = picked.withColumnsRenamed({n: f"_g_{n}" for n in names})
    out = totals.join(picked, same, "left")

    def quantile(q: int) -> Column:
        pos = (F.col("with_salary") - 1) * (q / 100)
        return F.round(F.col(f"_lo{q}") + (F.col(f"_hi{q}") - F.col(f"_lo{q}")) * (pos - F.floor(pos)), 2)

    return out.select(
        *names, "postings", "with_salary", _pct(F.col("with_salary"), F.col("postings")).alias("coverage_pct"), "min_mid",
        quantile(25).alias("p25_mid"), quantile(50).alias("median_mid"), quantile(75).alias("p75_mid"), "max_mid",
        F.round("_avg", 2).alias("avg_mid"))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


# --------------------------------------------------------------------------- D18
def role_trend(postings: DataFrame, role: str = "role", ts: str = "ts", grain: str = "year") -> DataFrame:
    """Postings per role and period, change against the role's previous period, dense rank in period."""
    period = F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz").alias("period")
    counts = postings.groupBy(role, period).agg(F.count(F.lit(1)).alias("count"))
    w_role = Window.partitionBy(role).orderBy("period")
    w_period = Window.partitionBy("period").orderBy(F.col("count").desc())
    prev = F.lag("count").over(w_role)
    return counts.select(
        role, "period", "count",
        prev.alias("prev_count"),
        F.round(F.try_divide((F.col("count") - prev) * F.lit(100.0), prev), 1).alias("change_pct"),
        F.dense_rank().over(w_period).alias("rank_in_period"),
    )
