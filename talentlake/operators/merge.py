"""A: merges into stored tables — upsert, partial patches, get-or-create, validated append, cascades.

Parquet has no row-level update, so every merge *computes the next snapshot*
as a DataFrame (one shuffle join on the key) and ``write_snapshot`` writes it
to a new directory; readers switch to the new directory afterwards.  Nothing
is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.session import scratch_path

# The content columns an upsert overwrites (others keep their stored value).
UPSERT_SET_COLS = ["company_name", "role_title", "location", "salary_min", "salary_max",
                   "description_text", "requirements_text"]
# Research finding categories accepted by the validated append.
FINDING_CATEGORIES = ["role_trend", "skill_demand", "salary_insight", "industry_news"]


def normalise_posting(df: DataFrame) -> DataFrame:
    """Input normalisation of a discovered posting: lower source, '' → NULL, salaries ≤ 0 → NULL."""
    exprs = {"source": F.lower(F.col("source"))}
    for c in ["source_url", "location", "remote_policy", "description_text", "requirements_text", "source_job_id"]:
        if c in df.columns:
            exprs[c] = F.nullif(F.col(c), F.lit(""))
    for c in ["salary_min", "salary_max"]:
        if c in df.columns:
            exprs[c] = F.when(F.col(c) > 0, F.col(c))
    return df.withColumns(exprs)


# --------------------------------------------------------------------------- A5
def merge_upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], set_cols: Sequence[str],
                 order_col: str | Column, now: Column | None, id_col: str = "id", active_col: str = "is_active",
                 updated_col: str | None = "updated_at", on_conflict: str = "update") -> DataFrame:
    """``INSERT ... ON CONFLICT (keys) DO UPDATE SET set_cols, is_active = true, updated_at = now``.

    * Updates are applied in ``order_col`` order: for a key, the stored row (or, for a new
      key, the *first* update, which inserted it) keeps its other columns, the ``set_cols``
      come from the *last* update.
    * An update without key takes its own id as key (it never conflicts).
    Both reductions are ``min_by``/``max_by`` aggregates (map-side partial), so a key
    repeated a million times in one batch is collapsed before the shuffle.
    Variants: ``set_cols=[]`` touches only is_active/updated_at; ``set_cols`` = all columns is a
    full overwrite; ``on_conflict="nothing"`` keeps stored rows as they are and only inserts new keys.
    """
    if on_conflict not in ("update", "nothing"):
        raise ValueError("on_conflict must be 'update' or 'nothing'")
    keys = list(keys)
    cols = target.columns
    order = F.col(order_col) if isinstance(order_col, str) else order_col
    u = updates.withColumn(keys[-1], F.coalesce(F.col(keys[-1]), F.col(id_col).cast("string")))
    others = [c for c in cols if c not in keys]
    ucols = [c for c in others if c in u.columns]
    red = u.groupBy(*keys).agg(
        F.min_by(F.struct(*ucols), order).alias("_first"),
        F.max_by(F.struct(*set_cols) if set_cols else F.struct(F.lit(True).alias("_hit")), order).alias("_last"),
    )
    t = target.withColumn("_in_t", F.lit(True))
    j = t.join(red, keys, "full_outer")
    if on_conflict == "nothing":
        # a conflicting update changes nothing: drop its reduction for keys already stored
        j = j.withColumns({"_last": F.when(F.col("_in_t").isNull(), F.col("_last")),
                           "_first": F.when(F.col("_in_t").isNull(), F.col("_first"))})
    out = []
    for c in others:
        if c in set_cols:
            out.append(F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c))
        elif c == active_col:
            out.append(F.when(F.col("_last").isNotNull(), F.lit(True)).otherwise(F.col(c)).alias(c))
        elif c == updated_col and now is not None:
            out.append(F.when(F.col("_last").isNotNull(), now).otherwise(F.col(c)).alias(c))
        elif c in ucols:
            out.append(F.when(F.col("_in_t").isNull(), F.col(f"_first.{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*keys, *out).select(*cols)


def write_snapshot(df: DataFrame, base: str | None = None, name: str = "snapshot") -> str:
    """Write the next version of a table to a fresh directory under the shared checkpoint root."""
    spark: SparkSession = df.sparkSession
    path = base or scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return path


# --------------------------------------------------------------------------- A6
def append_findings(df: DataFrame, category: str = "category", relevance: str = "relevance_score",
                    metadata: str = "metadata", url: str = "source_url") -> tuple[DataFrame, DataFrame]:
    """Validated append: (accepted, rejected).  Category must be one of four; relevance is clamped
    to 0..100; metadata that is not valid JSON becomes '{}'; '' url becomes NULL."""
    ok = F.coalesce(F.col(category).isin(FINDING_CATEGORIES), F.lit(False))
    clean = df.withColumns({
        relevance: F.least(F.greatest(F.col(relevance), F.lit(0)), F.lit(100)),
        metadata: F.when(F.try_parse_json(F.col(metadata)).isNotNull(), F.col(metadata)).otherwise(F.lit("{}")),
        url: F.nullif(F.col(url), F.lit("")),
    })
    accepted = clean.where(ok)
    rejected = df.where(~ok).withColumn("reject_reason", F.concat(F.lit("invalid category: "),
                                                                  F.coalesce(F.col(category), F.lit("null"))))
    return accepted, rejected


# --------------------------------------------------------------------------- A7
def cascade_delete(tables: Mapping[str, DataFrame], edges: Sequence[tuple[str, str, str, str, str]],
                   root: str, root_key: str, ids: DataFrame, owner: str | None = None) -> dict[str, DataFrame]:
    """Delete ``ids`` from ``root`` and follow foreign keys down.

    With ``owner`` the second column of ``ids`` says who asks: a root row goes only if its ``owner``
    column is equal (foreign rows and their children stay).

    ``edges``: (parent, parent_key, child, child_fk, action) with action 'cascade' or 'set_null',
    listed parent-before-child.  Deleted keys flow down as DataFrames (anti/semi joins), never lists.
    """
    on = [root_key] if owner is None else [root_key, owner]
    asked = ids.select(*[F.col(c).alias(name) for c, name in zip(ids.columns, on)])
    deleted: dict[str, DataFrame] = {root: tables[root].join(asked, on, "left_semi")}
    out = dict(tables)
    out[root] = tables[root].join(deleted[root].select(root_key), root_key, "left_anti")
    for parent, pkey, child, fk, action in edges:
        if parent not in deleted:
            continue
        gone = deleted[parent].select(F.col(pkey).alias("_gone"))
        cur = out[child]
        hit = cur.join(gone, cur[fk] == gone._gone, "left_semi")
        if action == "cascade":
            deleted[child] = hit if child not in deleted else deleted[child].unionByName(hit)
            out[child] = cur.join(gone, cur[fk] == gone._gone, "left_anti")
        else:  # set_null
            marked = cur.join(gone.withColumn("_hit", F.lit(True)), cur[fk] == gone._gone, "left")
            out[child] = marked.withColumn(fk, F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(fk))).drop("_gone", "_hit")
    return out


# --------------------------------------------------------------------------- A10
def apply_patches(target: DataFrame, patches: DataFrame, key: str, allowed: Sequence[str], order: str,
                  positive: Sequence[str] = ()) -> DataFrame:
    """Partial update: per key and allowed column, the latest non-NULL patch value wins.

    Columns in ``positive`` (salaries) never take a zero/negative/NULL value.  Columns outside
    ``allowed`` are ignored.  One aggregate per key (partial map-side), one left join.
    """
    allowed = [c for c in allowed if c in patches.columns]

    def val(c):
        v = F.col(c)
        return F.when(v > 0, v) if c in positive else v

    agg = patches.groupBy(F.col(key).alias("_k")).agg(*[
        F.max_by(val(c), F.when(val(c).isNotNull(), F.struct(F.col(order), val(c)))).alias(f"_p_{c}") for c in allowed
    ])
    j = target.join(agg, target[key] == agg._k, "left")
    return j.select(*[F.coalesce(F.col(f"_p_{c}"), target[c]).alias(c) if c in allowed else target[c]
                      for c in target.columns])


# --------------------------------------------------------------------------- A11
def insert_if_absent(users: DataFrame, signups: DataFrame, key: str, order: str, token_name: str = "token_name",
                     email: str = "email", default_arrays: Sequence[str] = ()) -> DataFrame:
    """Get-or-create: existing keys untouched; the first signup of a new key creates the row.

    name = token name, else the e-mail local part, else 'New User'; array columns default to [].
    """
    new = signups.join(users.select(key), key, "left_anti")
    first = new.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), F.col(order)).alias("_s"))
    name = F.coalesce(F.nullif(F.trim(F.col(f"_s.{token_name}")), F.lit("")),
                      F.nullif(F.split_part(F.col(f"_s.{email}"), F.lit("@"), F.lit(1)), F.lit("")),
                      F.lit("New User"))
    created = first.select(key, name.alias("name"), F.col(f"_s.{email}").alias("email"),
                           *[F.array().cast("array<string>").alias(c) for c in default_arrays])
    return users.unionByName(created, allowMissingColumns=True)


def fill_from_profile(df: DataFrame, profile: str, mapping: Mapping[str, str]) -> DataFrame:
    """A10 header fill: an empty/NULL column takes the value of a field of the parsed profile struct
    (e.g. ``{"company_name": "company", "role_title": "role_title"}``); set values are kept."""
    return df.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).cast(df.schema[c].dataType),
                                         F.col(profile).getField(field).cast(df.schema[c].dataType))
                           for c, field in mapping.items()})


def toggle_saved(target: DataFrame, toggles: DataFrame, key: str, flag: str = "is_saved") -> DataFrame:
    """A10 toggle: each toggle event flips the flag once; an odd number of toggles inverts it.
    Counted per key (partial aggregation), then one left join."""
    n = toggles.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    j = target.join(n, target[key] == n._k, "left")
    flipped = F.when(F.coalesce(F.col("_n"), F.lit(0)) % 2 == 1, ~F.coalesce(F.col(flag), F.lit(False))) \
        .otherwise(F.coalesce(F.col(flag), F.lit(False)))
    return j.select(*[flipped.alias(c) if c == flag else target[c] for c in target.columns])
