"""C: joins between analyses, postings, CVs, applications and dimensions.

Join strategy is left to Catalyst/AQE (sort-merge, shuffled hash or
broadcast by measured size).  Facts are reduced to one row per key *before*
they are joined whenever the result needs one row per key (no fan-out, no
inflated counts).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentlake.operators.common import words
from talentlake.operators.ranking import latest_per_key


# --------------------------------------------------------------------------- C1
def analyses_with_context(ga: DataFrame, jp: DataFrame, cv: DataFrame, owner: Column | None = None) -> DataFrame:
    """Analyses ⋈ posting ⋈ CV version (inner), newest first; ``owner`` filters before the join.

    ``ga``: id, job_id, cv_version_id, fit_score, ats_score, created_at
    ``jp``: id, company_name, role_title;  ``cv``: id, version_name.
    """
    src = ga.where(owner) if owner is not None else ga
    jp_ = jp.select(F.col("id").alias("_jp_id"), "company_name", "role_title")
    cv_ = cv.select(F.col("id").alias("_cv_id"), F.col("version_name").alias("cv_version"))
    return (
        src.join(jp_, src.job_id == jp_._jp_id)
        .join(cv_, src.cv_version_id == cv_._cv_id)
        .select("id", "fit_score", "ats_score", "created_at", "company_name", "role_title", "cv_version")
        .orderBy(F.col("created_at").desc_nulls_first(), F.col("id"))
    )


# --------------------------------------------------------------------------- C2
def sessions_with_posting(s: DataFrame, jp: DataFrame, s_key: str = "job_id", jp_key: str = "job_id") -> DataFrame:
    """Sessions LEFT JOIN postings: sessions without a posting are kept with NULL posting columns."""
    return s.join(jp, s[s_key] == jp[jp_key], "left").drop(jp[jp_key])


# --------------------------------------------------------------------------- C3
def applications_enriched(a: DataFrame, jp: DataFrame, ga: DataFrame, fanout: bool = False) -> DataFrame:
    """Applications ⟕ posting ⟕ analysis of the posting.

    Default: only the newest analysis per job is attached (E2 first), so every
    application appears once.  ``fanout=True`` reproduces the plain SQL shape
    (one row per application × analysis of its job).
    """
    jp_ = jp.select(F.col("id").alias("_jp_id"), F.col("role_title").alias("posting_role"),
                    F.col("company_name").alias("posting_company"))
    an = ga.select(F.col("id").alias("analysis_id"), F.col("job_id").alias("_ga_job"),
                   F.col("fit_score").alias("analysis_fit"), F.col("created_at").alias("analysis_at"))
    if not fanout:
        an = latest_per_key(an, "_ga_job", "analysis_at", tiebreak="analysis_id")
    out = a.join(jp_, a.job_id == jp_._jp_id, "left").join(an, a.job_id == an._ga_job, "left")
    return out.drop("_jp_id", "_ga_job")


# --------------------------------------------------------------------------- C4
def save_key(user: str, url: str, role: str) -> list[Column]:
    return [F.col(user), F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(role), F.lit(""))]


def not_yet_saved(discovered: DataFrame, saved: DataFrame, user: str = "user_id", url: str = "source_url",
                  role: str = "role_title") -> DataFrame:
    """Save-once check on (user, url, role); a NULL url is compared as '' on both sides."""
    d = discovered.withColumns({"_u": F.col(user), "_url": F.coalesce(F.col(url), F.lit("")),
                                "_r": F.coalesce(F.col(role), F.lit(""))})
    s = saved.select(F.col(user).alias("_u"), F.coalesce(F.col(url), F.lit("")).alias("_url"),
                     F.coalesce(F.col(role), F.lit("")).alias("_r"))
    return d.join(s, ["_u", "_url", "_r"], "left_anti").drop("_u", "_url", "_r")


# --------------------------------------------------------------------------- C5
def skill_alias_map(dim: DataFrame, name: str = "name", aliases: str = "aliases") -> DataFrame:
    """(alias_key → canonical) from name ∪ aliases, keys lower-cased and trimmed.

    When one key could map to several names, the entry that *is* the name wins,
    else the smallest name — a deterministic, one-row-per-key map.
    """
    own = dim.select(F.lower(F.trim(F.col(name))).alias("alias_key"), F.col(name).alias("canonical"),
                     F.lit(0).alias("_pri"))
    al = dim.select(F.explode(F.col(aliases)).alias("_a"), F.col(name).alias("canonical")).select(
        F.lower(F.trim("_a")).alias("alias_key"), "canonical", F.lit(1).alias("_pri"))
    both = own.unionByName(al).where(F.col("alias_key") != "")
    return both.groupBy("alias_key").agg(
        F.min_by("canonical", F.struct("_pri", "canonical")).alias("canonical"))


def canonical_skills(df: DataFrame, dim: DataFrame, skill: str = "skill", name: str = "name",
                     aliases: str = "aliases") -> DataFrame:
    """Map ``skill`` to its canonical name through the dictionary; unknown skills map to themselves.

    The dictionary is broadcast where Spark's own size bound allows it."""
    m = skill_alias_map(dim, name, aliases)
    keyed = df.withColumn("_k", F.lower(F.trim(F.col(skill))))
    out = keyed.join(m, keyed._k == m.alias_key, "left")
    return out.select(*df.columns, F.coalesce(F.col("canonical"), F.col(skill)).alias("canonical_skill"))


# --------------------------------------------------------------------------- C6
def match_requirements(pairs: DataFrame, job_reqs: DataFrame, cv_skills: DataFrame) -> DataFrame:
    """Requirement status per (cv, job, requirement): met / short / missing.

    ``pairs``: cv_id, job_id;  ``job_reqs``: job_id, req_id, skill, years_required (NULL = no minimum);
    ``cv_skills``: cv_id, skill, years.  Equi keys (job_id) then (cv_id, skill); the years test is
    the residual condition evaluated after the equi join.
    """
    req = pairs.join(job_reqs, "job_id")
    cs = cv_skills.groupBy("cv_id", "skill").agg(F.max("years").alias("cv_years"), F.lit(True).alias("_has"))
    m = req.join(cs, ["cv_id", "skill"], "left")
    status = (
        F.when(F.col("_has").isNull(), F.lit("missing"))
        .when(F.col("years_required").isNull() | (F.coalesce(F.col("cv_years"), F.lit(0)) >= F.col("years_required")),
              F.lit("met"))
        .otherwise(F.lit("short"))
    )
    return m.select("cv_id", "job_id", "req_id", "skill", "years_required", "cv_years", status.alias("status"))


# --------------------------------------------------------------------------- C7
def phrase_key(phrase: Column) -> Column:
    """Normal form of a phrase: its word tokens joined by single spaces ('' when it has none)."""
    return F.array_join(words(phrase), " ")


def phrase_match(texts: DataFrame, text_id: str, text: str, phrases: DataFrame, phrase_id: str,
                 phrase: str) -> DataFrame:
    """(text_id, phrase_id) where the phrase occurs in the text as whole words (case-insensitive).

    No nested loop and no scan per phrase: positions whose word starts no phrase are dropped by a
    semi join with the first words (broadcast where Spark's size bound allows it), then the text's
    n-grams up to the longest phrase are equi-joined with the normalised phrases, so only real
    matches meet.
    """
    p = phrases.select(F.col(phrase_id).alias("_pid"), phrase_key(F.col(phrase)).alias("ngram")).where(F.col("ngram") != "")
    tokens = F.split("ngram", " ")
    longest = p.agg(F.coalesce(F.max(F.size(tokens)), F.lit(1))).scalar()
    t = texts.select(F.col(text_id).alias("_tid"), words(F.col(text)).alias("_tok"))
    pos = t.select("_tid", F.posexplode("_tok").alias("_pos", "_w0"), "_tok")
    # the window of each position, so that the semi join moves a few words and not the whole text
    win = pos.select("_tid", "_w0", F.slice("_tok", F.col("_pos") + 1, longest).alias("_win"))
    win = win.join(p.select(tokens[0].alias("_w0")).distinct(), "_w0", "left_semi")
    grams = F.transform(F.sequence(F.lit(1), F.size("_win")), lambda n: F.array_join(F.slice("_win", 1, n), " "))
    g = win.select("_tid", F.explode(grams).alias("ngram"))
    return g.join(p, "ngram").select(F.col("_tid").alias(text_id), F.col("_pid").alias(phrase_id)).distinct()


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters, as an array in the row."""
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>"))


def substring_match(texts: DataFrame, text: str, targets: DataFrame, target: str) -> DataFrame:
    """(text, target) of the distinct values where the target is a substring of the text, case as it is.

    A trigram index instead of a nested loop: a target's key is the one of its trigrams that fewest texts hold
    (of targets under three characters, the target itself), texts are joined by their own grams, and candidates
    are verified with ``contains``.  A target with a trigram that no text holds is gone before the join, and a
    trigram that most texts hold is a key only of targets that hold nothing rarer.
    """
    texts = texts.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct()
    targets = targets.select(F.col(target).alias("_target")).where("_target <> ''").distinct()
    size = F.least(F.length("_target"), F.lit(3))
    sizes = [r[0] for r in targets.select(size).distinct().collect()]  # 1, 2, 3
    if not sizes:
        return texts.select(F.col("_text").alias(text), F.lit(None).cast("string").alias(target)).limit(0)
    own = targets.select("_target", F.explode(F.concat(*[F.when(size == n, _grams(F.col("_target"), n)).otherwise(
        F.array().cast("array<string>")) for n in sizes])).alias("_gram"))
    grams = texts.select("_text", F.explode(F.concat(*[_grams(F.col("_text"), n) for n in sizes])).alias("_gram"))
    held = (grams.join(own.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n")))
    rarest = own.join(held, "_gram", "left").groupBy("_target").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_key"))
    keys = rarest.where("_key.n > 0").select("_target", F.col("_key.gram").alias("_gram"))
    return (grams.join(keys, "_gram").where(F.col("_text").contains(F.col("_target")))
            .select(F.col("_text").alias(text), F.col("_target").alias(target)))


#: keys of locations: "=" and the target, or this for remote postings
REMOTE_KEY = "*"


def preference_match(users: DataFrame, postings: DataFrame, user: str = "user_id", roles: str = "target_roles",
                     locations: str = "target_locations", posting: str = "id", title: str = "role_title",
                     location: str = "location", remote: str = "remote_policy", active: str = "is_active",
                     order: Sequence[Column] | None = None, per_user: int | None = None) -> DataFrame:
    """Active postings whose title contains a target role and whose location contains a target location (or
    that are remote), as (user, posting) rows.  "Contains" is plain and case-insensitive: "java" is in
    "JavaScript"; blanks around a target do not count, a blank target matches nothing.

    Distinct titles and distinct locations meet the distinct targets (``substring_match``); postings and users
    then meet in one equi-join on (role target, location target or the remote marker).  With ``per_user``
    only the first postings by ``order`` stay: of postings with one title, location and policy (a hot one may
    hold a third of all), then per key before the join, then per user after it; each of these sends
    ``per_user`` rows of a task, and the join never holds users x postings.
    """
    if per_user is not None and not order:
        raise ValueError("per_user needs an order")
    plain = lambda c: F.lower(F.trim(c))
    u = users.select(F.col(user).alias("_u"), F.explode(roles).alias("_r"), F.col(locations).alias("_ls"))
    near = F.transform(F.filter(F.transform(F.col("_ls"), plain), lambda x: x != ""), lambda x: F.concat(F.lit("="), x))
    u = u.select("_u", plain(F.col("_r")).alias("_role"),
                 F.explode(F.array_union(F.coalesce(near, F.array().cast("array<string>")), F.array(F.lit(REMOTE_KEY)))).alias("_loc"))
    u = u.where(F.col("_role") != "").distinct()
    rank = [F.struct(*order).alias("_order")] if order else []
    ordered = ["_order"] if order else []
    live = postings.where(F.col(active)).select(
        F.col(posting).alias("_p"), *rank, F.lower(F.col(title)).alias("_title"), F.lower(F.col(location)).alias("_place"),
        F.coalesce(F.lower(F.col(remote)) == "remote", F.lit(False)).alias("_remote"))
    if per_user is not None:
        alike = Window.partitionBy("_title", "_place", "_remote").orderBy("_order", "_p")
        live = live.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= per_user).drop("_n")
    in_title = substring_match(live, "_title", u, "_role")
    place = u.where(F.col("_loc") != REMOTE_KEY).select(F.substring("_loc", 2, 1 << 30).alias("_target"))
    in_place = substring_match(live, "_place", place, "_target").select("_place", F.concat(F.lit("="), "_target").alias("_loc"))
    fit = live.join(in_title, "_title")
    keys = (fit.join(in_place, "_place").select("_p", *ordered, "_role", "_loc")
            .unionByName(fit.where("_remote").select("_p", *ordered, "_role", F.lit(REMOTE_KEY).alias("_loc"))))
    if per_user is None:
        return u.join(keys, ["_role", "_loc"]).select(F.col("_u").alias(user), F.col("_p").alias(posting)).distinct()
    first = Window.partitionBy("_role", "_loc").orderBy("_order", "_p")
    keys = keys.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_user).drop("_n")
    pairs = u.join(keys, ["_role", "_loc"]).select("_u", "_p", "_order").distinct()
    best = Window.partitionBy("_u").orderBy("_order", "_p")
    return (pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_user)
            .select(F.col("_u").alias(user), F.col("_p").alias(posting), "rank"))


# --------------------------------------------------------------------------- C8
def build_analysis_inputs(requests: DataFrame, cv: DataFrame, jp: DataFrame, as_json: bool = False) -> DataFrame:
    """Attach CV and posting to each request by (id, owner); foreign or unknown ids stay NULL.

    ``requests``: request_id, user_id, cv_version_id, job_posting_id;  ``cv``: id, user_id, version_name;
    ``jp``: id, user_id, role_title, company_name.  Two LEFT joins on the composite key.
    """
    c = cv.select(F.col("id").alias("cv_version_id"), F.col("user_id"), F.col("version_name").alias("cv_version"))
    j = jp.select(F.col("id").alias("job_posting_id"), F.col("user_id"), F.col("role_title").alias("job_role"),
                  F.col("company_name").alias("job_company"))
    out = requests.join(c, ["cv_version_id", "user_id"], "left").join(j, ["job_posting_id", "user_id"], "left")
    out = out.select("request_id", "user_id", "cv_version_id", "job_posting_id", "cv_version", "job_role", "job_company")
    if as_json:
        payload = F.struct(
            F.when(F.col("cv_version").isNotNull(), F.struct(F.col("cv_version").alias("version"))).alias("cv"),
            F.when(F.col("job_role").isNotNull(),
                   F.struct(F.col("job_role").alias("role_title"), F.col("job_company").alias("company_name"))).alias("job"),
        )
        out = out.withColumn("payload", F.to_json(payload))  # NULL parts are omitted by to_json
    return out
