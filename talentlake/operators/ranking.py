"""E: per-key ranking, feeds, dedupe and queues.

Per-group "first n" uses ``row_number() <= n`` over a window: Spark rewrites
this into a ``WindowGroupLimit`` that already trims every group to n rows
*before* the shuffle, so a user or key holding a third of the rows costs n
rows per map partition in the exchange, not its whole history.  Single
winners per key use ``max_by``/``min_by`` aggregates, which are partially
aggregated map-side for the same reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# --------------------------------------------------------------------------- E1
def latest_n(df: DataFrame, by: str | Sequence[str], ts: str, n: int, key: str = "id") -> DataFrame:
    """Newest ``n`` rows per group (NULL times first, as PostgreSQL's DESC), id as tiebreak."""
    if n < 0:
        raise ValueError("n must be >= 0")
    w = Window.partitionBy(*_cols(by)).orderBy(F.col(ts).desc_nulls_first(), F.col(key).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# --------------------------------------------------------------------------- E2
def latest_per_key(df: DataFrame, key: str | Sequence[str], ts: str, pred: Column | None = None,
                   tiebreak: str = "id") -> DataFrame:
    """Newest row per key (ties: larger id), optionally among rows matching ``pred``.

    ``max_by(struct(row), struct(ts, id))`` is an ordinary aggregate: partial
    per map partition, final after the shuffle — no sort of a hot key's rows.
    """
    src = df.where(pred) if pred is not None else df
    keys = _cols(key)
    others = [c for c in src.columns if c not in keys]
    best = src.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(F.col(ts), F.col(tiebreak))).alias("_row")
    )
    return best.select(*keys, "_row.*")


# --------------------------------------------------------------------------- E3
def default_cv(cv: DataFrame, user: str = "user_id", primary: str = "is_primary", ts: str = "created_at",
               key: str = "id") -> DataFrame:
    """The user's primary CV, else the newest (list order: primary desc, created desc, id)."""
    w = Window.partitionBy(user).orderBy(
        F.col(primary).desc_nulls_last(), F.col(ts).desc_nulls_first(), F.col(key).asc()
    )
    return cv.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# --------------------------------------------------------------------------- E4
def ranked_feed(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, cap: int = 50) -> DataFrame:
    """One page of a feed: limit capped at ``cap``; negative limit/offset rejected.

    ``orderBy().offset().limit()`` plans as ``TakeOrderedAndProject``: each task
    keeps only offset+limit rows, the driver merges them.
    """
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must be >= 0")
    return df.orderBy(*order).offset(offset).limit(min(limit, cap))


def feed_page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, cap: int = 50) -> DataFrame:
    """A page whose rows also hold ``total``, the number of rows of the whole (filtered) feed."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return ranked_feed(df, order, limit, offset, cap).withColumn("total", total)


def findings_order(featured: str = "is_featured", relevance: str = "relevance_score", ts: str = "created_at",
                   key: str = "id") -> list[Column]:
    return [F.col(featured).desc_nulls_first(), F.col(relevance).desc_nulls_first(),
            F.col(ts).desc_nulls_first(), F.col(key).asc()]


# --------------------------------------------------------------------------- E5
def dedupe_key(source_id: str = "source_job_id", role: str = "role_title", company: str = "company_name") -> Column:
    """Dedupe key: the source id, or role and company put together when it is empty; NULL when all
    are empty.  Case and spaces count."""
    both = F.concat(F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(company), F.lit("")))
    return F.coalesce(F.nullif(F.col(source_id), F.lit("")), F.nullif(both, F.lit("")))


def dedupe_first(df: DataFrame, key_expr: Column, order: str | Sequence[str]) -> DataFrame:
    """First-seen row per key (by arrival order); rows without a key are dropped.

    Written as ``min_by`` so that copies of one hot key are collapsed map-side.
    """
    order_cols = _cols(order)
    keyed = df.withColumn("_key", key_expr).where(F.col("_key").isNotNull())
    others = [c for c in df.columns]
    first = keyed.groupBy("_key").agg(
        F.min_by(F.struct(*others), F.struct(*[F.col(c) for c in order_cols])).alias("_row")
    )
    return first.select(F.col("_key").alias("dedupe_key"), "_row.*")


# --------------------------------------------------------------------------- E6
def enforce_single_primary(cv: DataFrame, changes: DataFrame, user: str = "user_id", key: str = "id",
                           primary: str = "is_primary", change_cv: str = "cv_id", change_ts: str = "ts") -> DataFrame:
    """Apply 'set primary' changes: the user's last change wins, every other CV of that user is unset."""
    last = changes.groupBy(F.col(user).alias("_u")).agg(
        F.max_by(F.col(change_cv), F.struct(F.col(change_ts), F.col(change_cv))).alias("_primary_cv")
    )
    joined = cv.join(last, cv[user] == last["_u"], "left")
    return joined.select(
        *[c for c in cv.columns if c != primary],
        F.when(F.col("_primary_cv").isNotNull(), F.col(key) == F.col("_primary_cv"))
        .otherwise(F.coalesce(F.col(primary), F.lit(False))).alias(primary),
    )


# --------------------------------------------------------------------------- E8
def pending_queue(jobs: DataFrame, n: int, status: str = "status", ts: str = "created_at", key: str = "id") -> DataFrame:
    """Oldest pending jobs first (global FIFO), n per worker call."""
    if n < 0:
        raise ValueError("n must be >= 0")
    return jobs.where(F.col(status) == "pending").orderBy(F.col(ts).asc_nulls_last(), F.col(key).asc()).limit(n)
