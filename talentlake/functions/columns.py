"""Column functions: salary, remote policy, external ids, labels, formatting.

Each returns a native ``Column`` (no Python per row), so it runs inside
whole-stage codegen and can be used in any select/filter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentlake.operators.aggs import fit_band, severity_rank  # noqa: F401  (re-exported: T14)

# The salary amount pattern (optional '$', digits and commas, optional decimals,
# optional thousands suffix K), and the canonical posting URL format of the job source.
SALARY_AMOUNT = r"\$?[0-9,]+\.?[0-9]*[kK]?"
VIEW_URL_PREFIX = "https://www.indeed.com/viewjob?jk="


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --------------------------------------------------------------------------- T1
def salary_amounts(text: str | Column, strict_ref: bool = False) -> Column:
    """All amounts in the text as BIGINT (array).

    Rule: an amount below 1000 is in thousands when a 'k' directly follows it
    (``strict_ref=True``: when the text holds a 'k' anywhere, as the reference
    does — "a week" then multiplies).  Tokens without a digit (a lone comma) are skipped.
    """
    t = _c(text)
    matches = F.regexp_extract_all(t, F.lit(SALARY_AMOUNT), 0)
    any_k = F.lower(t).contains("k")

    def to_value(m):
        num = (F.regexp_replace(m, r"[^0-9.]", "")).try_cast("double")
        has_k = any_k if strict_ref else F.lower(m).endswith("k")
        scaled = F.when((num < 1000) & has_k, num * 1000).otherwise(num)
        return F.floor(scaled).cast("bigint")

    return F.filter(F.transform(matches, to_value), lambda v: v.isNotNull())


def parse_salary(text: str | Column, strict_ref: bool = False) -> Column:
    """``struct(salary_min, salary_max)``: ≥2 amounts → min, max; 1 → both; none → (0, 0)."""
    vals = salary_amounts(text, strict_ref)
    has = F.coalesce(F.size(vals), F.lit(0)) > 0
    return F.struct(
        F.when(has, F.array_min(vals)).otherwise(F.lit(0).cast("bigint")).alias("salary_min"),
        F.when(has, F.array_max(vals)).otherwise(F.lit(0).cast("bigint")).alias("salary_max"),
    )


# --------------------------------------------------------------------------- T2
def remote_policy(*texts: str | Column) -> Column:
    """remote (and not hybrid) / hybrid / onsite (on-site, onsite, in-office) / ''."""
    t = F.lower(F.concat_ws(" ", *[_c(x) for x in texts]))
    return (
        F.when(t.contains("remote") & ~t.contains("hybrid"), F.lit("remote"))
        .when(t.contains("hybrid"), F.lit("hybrid"))
        .when(t.contains("on-site") | t.contains("onsite") | t.contains("in-office"), F.lit("onsite"))
        .otherwise(F.lit(""))
    )


# --------------------------------------------------------------------------- T3
def external_id(url: str | Column, data_jk: str | Column | None = None) -> Column:
    """Job key: ``jk=<hex>`` in the link, else the card's ``data-jk`` attribute, else ''."""
    from_url = F.nullif(F.regexp_extract(_c(url), r"jk=([a-f0-9]+)", 1), F.lit(""))
    parts = [from_url] + ([F.nullif(_c(data_jk), F.lit(""))] if data_jk is not None else [])
    return F.coalesce(*parts, F.lit(""))


def canonical_url(job_key: str | Column) -> Column:
    k = _c(job_key)
    return F.when(k != "", F.concat(F.lit(VIEW_URL_PREFIX), k)).otherwise(F.lit(""))


# --------------------------------------------------------------------------- T9
def ats_score(present: Column, keywords: Column) -> Column:
    """round(100 · |present| / |keywords|), 0 when there are no keywords (INT)."""
    n = F.size(keywords)
    return F.when(n > 0, F.round(F.size(present) * 100.0 / n).cast("int")).otherwise(F.lit(0))


# --------------------------------------------------------------------------- T13
def age_label(ts: str | Column, now: Column) -> Column:
    """<1h 'Just now', <24h 'Nh ago', <7d 'Nd ago', else 'MMM d, yyyy'.  ``now`` is an argument."""
    hours = F.timestamp_diff("HOUR", _c(ts), now)
    days = F.floor(hours / 24)
    return (
        F.when(hours < 1, F.lit("Just now"))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(_c(ts), "MMM d, yyyy"))
    )


# --------------------------------------------------------------------------- T14
def score_label(score: str | Column, scheme: str = "ui") -> Column:
    return fit_band(_c(score), scheme)


# --------------------------------------------------------------------------- T16
def format_salary(lo: str | Column, hi: str | Column, currency: str | Column | None = None) -> Column:
    """``$90,000 - 135,000``; ``$90,000+`` when the maximum is missing; NULL when both are missing/0."""
    lo_, hi_ = _c(lo), _c(hi)
    cur = F.coalesce(_c(currency), F.lit("$")) if currency is not None else F.lit("$")
    lo_txt = F.coalesce(F.format_number(lo_, 0), F.lit(""))
    tail = F.when(F.coalesce(hi_, F.lit(0)) != 0, F.concat(F.lit(" - "), F.format_number(hi_, 0))).otherwise(F.lit("+"))
    shown = (F.coalesce(lo_, F.lit(0)) != 0) | (F.coalesce(hi_, F.lit(0)) != 0)
    return F.when(shown, F.concat(cur, lo_txt, tail))


# --------------------------------------------------------------------------- T17
def role_from_slug(slug: str | Column) -> Column:
    """``data_scientist`` → ``Data Scientist``."""
    return F.initcap(F.regexp_replace(_c(slug), "_", " "))
