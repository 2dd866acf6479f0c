"""T4: job postings out of raw job-board pages.

Per page: the result cards when there are any (parsed by one pandas UDF with
the stdlib HTML parser); only for pages without cards, the JSON-LD
``JobPosting`` blocks and the embedded provider JSON, both extracted natively
(regex + ``from_json``).  Salary, remote policy, ids and URLs are native Column
functions applied afterwards.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from talentlake.functions.columns import canonical_url, parse_salary, remote_policy
from talentlake.functions.text import visible_text

# Script patterns of the job board pages.
JSONLD_RE = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
MOSAIC_RE = r"(?s)window\.mosaic\.providerData\[\"mosaic-provider-jobcards\"\]\s*=\s*(\{.*?\});"
PROVIDER_SCRIPT_RE = r"(?is)<script[^>]*\bid=[\"'][^\"']*mosaic-provider-jobcards[^\"']*[\"'][^>]*>(.*?)</script>"
# A card selector can only match when one of these class names occurs in the page text.
CARD_MARKER_RE = r"job_seen_beacon|jobsearch-ResultsList|css-5lfssm"
SOURCE = "indeed"
MAX_DESCRIPTION = 5000

JSONLD_SCHEMA = ("`@type` STRING, title STRING, hiringOrganization STRING, jobLocation STRING, description STRING, "
                 "baseSalary STRING, url STRING, identifier STRING")
MOSAIC_SCHEMA = ("metaData STRUCT<mosaicProviderJobCardsModel: STRUCT<results: ARRAY<STRUCT<title: STRING, "
                 "company: STRING, formattedLocation: STRING, snippet: STRING, formattedSalary: STRING, "
                 "salarySnippet: STRUCT<text: STRING>, jobkey: STRING>>>>")
CARD_TYPE = ArrayType(StructType([StructField(c, StringType()) for c in (
    "role_title", "job_key", "company_name", "location", "salary_text", "description_text")]))
OUT_COLS = ["page_id", "kind", "pos", "source", "role_title", "company_name", "location", "description_text",
            "salary_min", "salary_max", "source_url", "source_job_id", "remote_policy"]


@F.pandas_udf(CARD_TYPE)
def _cards(pages: pd.Series) -> pd.Series:
    from talentlake.functions.html_cards import page_cards

    return pages.map(page_cards)


def _place(outer: str, inner: str) -> Column:
    """Position of an item in a list of lists as one long (2^32 items a list)."""
    return (F.shiftleft(F.col(outer).cast("long"), 32) + F.col(inner)).alias("pos")


def _json_field(obj: Column, path: str) -> Column:
    return F.when(F.trim(obj).startswith("{"), F.get_json_object(obj, path))


def extract_postings(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    src = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(html).alias("html"))

    # --- cards: one array per page out of one Python pass; pages without any card class name, which
    # cannot have cards, are not parsed.  Pages are then told apart by the size of the array.
    src = src.withColumn("has_class", F.col("html").rlike(CARD_MARKER_RE))
    parsed = src.where("has_class").withColumn("cards", _cards("html"))
    cards_raw = parsed.select("page_id", F.posexplode("cards").alias("pos", "c")).select(
        "page_id", F.col("pos").cast("long").alias("pos"), "c.*")
    sal = parse_salary(F.col("salary_text"))
    cards = cards_raw.where(F.col("role_title") != "").select(
        "page_id", F.lit("card").alias("kind"), "pos", F.lit(SOURCE).alias("source"), "role_title", "company_name",
        "location", "description_text", sal["salary_min"].alias("salary_min"), sal["salary_max"].alias("salary_max"),
        canonical_url(F.col("job_key")).alias("source_url"), F.col("job_key").alias("source_job_id"),
        remote_policy(F.col("role_title"), F.col("location")).alias("remote_policy"))

    # --- pages without cards: JSON-LD and embedded provider JSON (native) ----------------
    rest = src.where(F.coalesce(~F.col("has_class"), F.lit(True))).select("page_id", "html").unionByName(
        parsed.where(F.size("cards") == 0).select("page_id", "html"))
    scripts = rest.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(JSONLD_RE), 1)).alias("s_pos", "s"))
    s = F.trim(F.col("s"))
    items = F.when(s.startswith("["), F.from_json(s, f"ARRAY<STRUCT<{JSONLD_SCHEMA.replace(' STRING', ': STRING')}>>")) \
        .otherwise(F.array(F.from_json(s, JSONLD_SCHEMA)))
    ld = scripts.select("page_id", "s_pos", F.posexplode_outer(items).alias("i_pos", "j")).where(
        F.col("j").isNotNull() & (F.col("j.`@type`") == "JobPosting"))
    org = F.col("j.hiringOrganization")
    loc_obj = F.col("j.jobLocation")
    loc = F.concat_ws(", ", F.nullif(_json_field(loc_obj, "$.address.addressLocality"), F.lit("")),
                      F.nullif(_json_field(loc_obj, "$.address.addressRegion"), F.lit("")))
    desc_raw = F.coalesce(F.col("j.description"), F.lit(""))
    desc = F.left(F.when(desc_raw.contains("<"), visible_text(desc_raw)).otherwise(desc_raw), F.lit(MAX_DESCRIPTION))

    def money(path):
        v = _json_field(F.col("j.baseSalary"), path).try_cast("double")
        return F.coalesce(F.floor(v).cast("bigint"), F.lit(0).cast("bigint"))

    title = F.coalesce(F.col("j.title"), F.lit(""))
    jsonld = ld.select(
        "page_id", F.lit("jsonld").alias("kind"), _place("s_pos", "i_pos"),
        F.lit(SOURCE).alias("source"), title.alias("role_title"),
        F.when(F.trim(org).startswith("{"), F.coalesce(F.get_json_object(org, "$.name"), F.lit("Unknown")))
        .otherwise(F.coalesce(org, F.lit("Unknown"))).alias("company_name"),
        loc.alias("location"), desc.alias("description_text"),
        money("$.value.minValue").alias("salary_min"), money("$.value.maxValue").alias("salary_max"),
        F.coalesce(F.col("j.url"), F.lit("")).alias("source_url"),
        F.coalesce(_json_field(F.col("j.identifier"), "$.value"), F.lit("")).alias("source_job_id"),
        remote_policy(title, loc, F.left(desc, F.lit(500))).alias("remote_policy"))

    blobs = rest.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(PROVIDER_SCRIPT_RE), 1)).alias("b_pos", "b"))
    blobs = blobs.withColumn("b", F.regexp_extract("b", MOSAIC_RE, 1))
    res = blobs.select("page_id", "b_pos", F.posexplode(
        F.from_json("b", MOSAIC_SCHEMA)["metaData"]["mosaicProviderJobCardsModel"]["results"]).alias("r_pos", "r"))
    msal = parse_salary(F.coalesce(F.nullif(F.col("r.formattedSalary"), F.lit("")), F.col("r.salarySnippet.text"), F.lit("")))
    mtitle = F.coalesce(F.col("r.title"), F.lit(""))
    mloc = F.coalesce(F.col("r.formattedLocation"), F.lit(""))
    mosaic = res.select(
        "page_id", F.lit("mosaic").alias("kind"), _place("b_pos", "r_pos"),
        F.lit(SOURCE).alias("source"), mtitle.alias("role_title"),
        F.coalesce(F.col("r.company"), F.lit("Unknown")).alias("company_name"), mloc.alias("location"),
        F.left(F.coalesce(F.col("r.snippet"), F.lit("")), F.lit(MAX_DESCRIPTION)).alias("description_text"),
        msal["salary_min"].alias("salary_min"), msal["salary_max"].alias("salary_max"),
        F.concat(F.lit("https://www.indeed.com/viewjob?jk="), F.coalesce(F.col("r.jobkey"), F.lit(""))).alias("source_url"),
        F.coalesce(F.col("r.jobkey"), F.lit("")).alias("source_job_id"),
        remote_policy(mtitle, mloc).alias("remote_policy"))

    return cards.select(*OUT_COLS).unionByName(jsonld.select(*OUT_COLS)).unionByName(mosaic.select(*OUT_COLS))
