"""T: text, HTML and JSON jobs over whole documents, written as native Spark expressions.

Only two steps leave the JVM, both as Arrow-batched pandas UDFs: HTML entity
decoding (T5) and the balanced-brace JSON scan (T12).  The HTML card parser
of T4 lives in ``talentlake.functions.html_cards`` (``mapInPandas``).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from talentlake.operators.common import words
from talentlake.operators.joins import phrase_match

# Contact patterns (our rules; the reference leaves this to a model).
EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_RE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"
LINKEDIN_RE = r"linkedin\.com/in/[A-Za-z0-9_-]+"
GITHUB_RE = r"github\.com/[A-Za-z0-9_-]+"
# Years requirement pattern, bullet markers and rulers of posting/CV text.
YEARS_RE = r"([0-9]+)\+ years"
BULLET_RE = r"^[•*·-]\s+"
RULER_RE = r"^[=_*-]{3,}$"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --------------------------------------------------------------------------- T6
def contact_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """First e-mail, phone, LinkedIn and GitHub reference in the text (NULL when absent)."""
    t = _c(text)

    def first(p):
        return F.nullif(F.regexp_extract(t, p, 0), F.lit(""))

    return df.withColumns({"email": first(EMAIL_RE), "phone": first(PHONE_RE),
                           "linkedin_url": first(LINKEDIN_RE), "github_url": first(GITHUB_RE)})


# --------------------------------------------------------------------------- T7
def heading_section(h: Column) -> Column:
    """Heading text → section label (our rule)."""
    x = F.lower(h)
    return (
        F.when(x.contains("must"), F.lit("must_have"))
        .when(x.contains("nice") | x.contains("preferred") | x.contains("bonus"), F.lit("nice_to_have"))
        .when(x.contains("responsib"), F.lit("responsibilities"))
        .when(x.contains("skill"), F.lit("skills"))
        .when(x.contains("requirement") | x.contains("qualification"), F.lit("must_have"))
    )


def sections(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bullet lines of each document with the section of the heading above them.

    A heading is a short line that is upper-case or ends with ':'; rulers are skipped.  Lines are an array
    of the document's own row, so no line is shuffled; the array is cut at the headings (a slice for
    each), so every line is looked at once and the cost is linear in the document.
    """
    def is_bullet(t: Column) -> Column:
        return t.rlike(BULLET_RE)

    def is_heading(t: Column) -> Column:
        return (~is_bullet(t)) & (~t.rlike(RULER_RE)) & (t != "") & (
            (t.endswith(":") & (F.length(t) <= 40))
            | ((t == F.upper(t)) & t.rlike("[A-Z]") & (F.length(t) <= 60))
        )

    lines = F.transform(F.split(_c(text), "\n"), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), lines.alias("_lines")).withColumn(
        "_heads", F.filter("_lines", lambda x: is_heading(x["line"])))

    def run(head: Column, i: Column) -> Column:
        following = F.coalesce(F.get(F.col("_heads"), i + 1)["pos"], F.size("_lines"))
        below = F.slice("_lines", head["pos"] + 2, following - head["pos"] - 1)
        return F.transform(F.filter(below, lambda x: is_bullet(x["line"])), lambda b: F.struct(
            b["pos"].alias("pos"), b["line"].alias("line"), head["line"].alias("heading")))

    above = F.flatten(F.transform("_heads", run))
    item = F.regexp_replace(F.col("b.line"), BULLET_RE, "")
    return (
        rows.select("doc_id", F.explode(above).alias("b"))
        .select("doc_id", "b.pos", heading_section(F.col("b.heading")).alias("section"), "b.heading", item.alias("item"),
                (F.nullif(F.regexp_extract(item, YEARS_RE, 1), F.lit(""))).try_cast("int").alias("years_required"))
        .where(F.col("section").isNotNull())
    )


# --------------------------------------------------------------------------- T8
def keyword_tags(docs: DataFrame, keywords: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 keyword: str = "keyword") -> DataFrame:
    """(doc_id, keyword) for every dictionary keyword found in the document as whole words.

    Multi-word keywords allowed; one n-gram equi-join, no scan per keyword.
    """
    kw = keywords.select(F.col(keyword).alias("_kw")).distinct()
    hits = phrase_match(docs, doc_id, text, kw, "_kw", "_kw")
    return hits.select(doc_id, F.col("_kw").alias(keyword))


# --------------------------------------------------------------------------- T10
def gap_rows(match: DataFrame, req_type: str = "req_type") -> DataFrame:
    """C6 matches → gap rows (critical / high / medium / low) and strength rows (met)."""
    st, ty = F.col("status"), F.col(req_type)
    sev = (
        F.when(st == "met", F.lit(None).cast("string"))
        .when((ty == "must_have") & (st == "missing"), F.lit("critical"))
        .when((ty == "must_have") & (st == "short"), F.lit("high"))
        .when(ty == "implicit", F.lit("medium"))
        .when(ty == "nice_to_have", F.lit("low"))
    )
    kind = F.when(st == "met", F.lit("strength")).otherwise(F.lit("gap"))
    return match.withColumns({"kind": kind, "severity": sev})


# --------------------------------------------------------------------------- T11
def _nz_str(c: Column) -> Column:
    """Python truthiness of a string: NULL and '' are false."""
    return c.isNotNull() & (c != "")


def _nz_num(c: Column) -> Column:
    """Python truthiness of a number: NULL and 0 are false."""
    return c.isNotNull() & (c != 0)


def _lines(*parts: Column) -> Column:
    """Join the non-NULL parts with newlines (``concat_ws`` skips NULLs)."""
    return F.concat_ws("\n", *parts)


def render_cv(p: Column) -> Column:
    """CV profile struct → prompt text (header, summary, experience total, skills, jobs, education, certificates)."""
    name = F.coalesce(p["name"], F.lit("Unknown"))
    skills = F.coalesce(p["skills"], F.array())
    exps = F.coalesce(p["experience"], F.array())
    edus = F.coalesce(p["education"], F.array())
    certs = F.coalesce(p["certifications"], F.array())

    def skill_line(s):
        return F.concat(F.lit("- "), F.coalesce(s["name"], F.lit("")),
                        F.when(_nz_str(s["proficiency"]), F.concat(F.lit(" ("), s["proficiency"], F.lit(")"))).otherwise(F.lit("")),
                        F.when(_nz_num(s["years"]), F.concat(F.lit(" - "), s["years"].cast("string"), F.lit(" years"))).otherwise(F.lit("")))

    def exp_block(e):
        head = F.concat(F.lit("\n### "), F.coalesce(e["role"], F.lit("")), F.lit(" at "), F.coalesce(e["company"], F.lit("")),
                        F.lit(" ("), F.coalesce(e["start_date"], F.lit("")), F.lit(" - "),
                        F.coalesce(e["end_date"], F.lit("Present")), F.lit(")"))
        hl = F.transform(F.coalesce(e["highlights"], F.array()), lambda h: F.concat(F.lit("  - "), h))
        tech = F.coalesce(e["technologies"], F.array())
        used = F.when(F.size(tech) > 0, F.array(F.concat(F.lit("  Technologies: "), F.array_join(tech, ", ")))).otherwise(F.array())
        return F.array_join(F.concat(F.array(head), hl, used), "\n")

    def edu_line(e):
        return F.concat(F.lit("- "), F.coalesce(e["degree"], F.lit("")), F.lit(" in "), F.coalesce(e["field"], F.lit("")),
                        F.lit(" from "), F.coalesce(e["institution"], F.lit("")))

    return _lines(
        F.concat(F.lit("## Candidate: "), name), F.lit(""),
        F.when(_nz_str(p["summary"]), F.concat(F.lit("**Summary:** "), p["summary"], F.lit("\n"))),
        F.when(_nz_num(p["total_years_experience"]),
               F.concat(F.lit("**Total Experience:** "), p["total_years_experience"].cast("string"), F.lit(" years\n"))),
        F.when(F.size(skills) > 0, F.concat(F.lit("**Skills:**\n"), F.array_join(F.transform(skills, skill_line), "\n"), F.lit("\n"))),
        F.when(F.size(exps) > 0, F.concat(F.lit("**Work Experience:**\n"), F.array_join(F.transform(exps, exp_block), "\n"), F.lit("\n"))),
        F.when(F.size(edus) > 0, F.concat(F.lit("**Education:**\n"), F.array_join(F.transform(edus, edu_line), "\n"), F.lit("\n"))),
        F.when(F.size(certs) > 0, F.concat(F.lit("**Certifications:** "), F.array_join(certs, ", "), F.lit("\n"))),
    )


def render_job(p: Column, max_must: int | None = None, max_resp: int | None = None) -> Column:
    """Job profile struct → prompt text; the interview form caps must-haves (8) and responsibilities (6)."""
    must = F.coalesce(p["must_have"], F.array())
    nice = F.coalesce(p["nice_to_have"], F.array())
    resp = F.coalesce(p["responsibilities"], F.array())
    kws = F.coalesce(p["ats_keywords"], F.array())
    if max_must is not None:
        must = F.slice(must, 1, max_must)
    if max_resp is not None:
        resp = F.slice(resp, 1, max_resp)

    def req_line(r):
        return F.concat(F.lit("- "), F.coalesce(r["text"], F.lit("")),
                        F.when(_nz_num(r["years_required"]), F.concat(F.lit(" ("), r["years_required"].cast("string"), F.lit("+ years)"))).otherwise(F.lit("")),
                        F.when(_nz_str(r["category"]), F.concat(F.lit(" ["), r["category"], F.lit("]"))).otherwise(F.lit("")))

    header = F.concat(F.lit("## Job: "), F.coalesce(p["role_title"], F.lit("Unknown Role")), F.lit(" at "),
                      F.coalesce(p["company"], F.lit("Unknown Company")))
    return _lines(
        header, F.lit(""),
        F.when(_nz_str(p["location"]), F.concat(F.lit("**Location:** "), p["location"], F.lit(" ("),
                                            F.coalesce(p["remote_policy"], F.lit("unknown")), F.lit(")"))),
        F.when(_nz_str(p["seniority"]), F.concat(F.lit("**Seniority Level:** "), p["seniority"])),
        F.lit(""),
        F.when(F.size(must) > 0, F.concat(F.lit("**Must-Have Requirements:**\n"), F.array_join(F.transform(must, req_line), "\n"), F.lit("\n"))),
        F.when(F.size(nice) > 0, F.concat(F.lit("**Nice-to-Have:**\n"),
                                          F.array_join(F.transform(nice, lambda r: F.concat(F.lit("- "), F.coalesce(r["text"], F.lit("")))), "\n"), F.lit("\n"))),
        F.when(F.size(resp) > 0, F.concat(F.lit("**Responsibilities:**\n"),
                                          F.array_join(F.transform(resp, lambda r: F.concat(F.lit("- "), r)), "\n"), F.lit("\n"))),
        F.when(F.size(kws) > 0, F.concat(F.lit("**Key ATS Keywords:** "), F.array_join(kws, ", "), F.lit("\n"))),
    )


def _bullets(title: str, items: Column, most: int) -> Column:
    """A bold title, the first ``most`` items as bullets and an empty line; '' without items."""
    lines = F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit("\n- "), F.coalesce(x, F.lit(""))))
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n**{title}:**"), F.array_join(lines, ""), F.lit("\n"))).otherwise(F.lit(""))


def render_job_interview(p: Column, max_must: int = 8, max_resp: int = 6) -> Column:
    """Job profile struct → prompt text for interview questions."""
    head = F.concat(F.lit("## Role: "), F.coalesce(p["role_title"], F.lit("Unknown")), F.lit(" at "),
                    F.coalesce(p["company"], F.lit("Unknown")), F.lit("\nSeniority: "), F.coalesce(p["seniority"], F.lit("unknown")), F.lit("\n"))
    must = F.transform(F.coalesce(p["must_have"], F.array()), lambda r: r["text"])
    resp = F.coalesce(p["responsibilities"], F.array())
    return F.concat(head, _bullets("Key Requirements", must, max_must), _bullets("Responsibilities", resp, max_resp))


def render_gaps(gaps: Column, most: int = 5) -> Column:
    """Gap structs → list of what to address ('' without an analysis)."""
    label = lambda g: F.coalesce(g["missing_element"], g["requirement"], F.lit(""))
    lines = F.transform(F.slice(gaps, 1, most), lambda g: F.concat(F.lit("\n- "), label(g)))
    return F.when(gaps.isNull(), F.lit("")).otherwise(F.concat(F.lit("## Candidate Gaps to Address:"), F.array_join(lines, "")))


def render_gap_summary(a: Column, max_gaps: int = 5, max_keywords: int = 10) -> Column:
    """Gap analysis struct → scores, key gaps and missing keywords."""
    gaps = F.transform(F.slice(F.coalesce(a["gaps"], F.array()), 1, max_gaps), lambda g: g["missing_element"])
    words_ = F.slice(F.coalesce(a["keywords_missing"], F.array()), 1, max_keywords)
    return F.concat(F.lit("\nGap Analysis Results:\n- Fit Score: "), a["fit_score"].cast("string"), F.lit("/100\n- ATS Score: "),
                    a["ats_score"].cast("string"), F.lit("/100\n- Key Gaps: "), F.array_join(gaps, ", "),
                    F.lit("\n- Missing Keywords: "), F.array_join(words_, ", "), F.lit("\n"))


# --------------------------------------------------------------------------- T12
# A fenced block is ``` optionally followed by "json", up to the next ```.
FENCE_RE = r"```(?:json)?\s*([\s\S]*?)```"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fenced_json(text: str | Column) -> Column:
    """Content of the first fenced block, stripped (NULL when there is none)."""
    return F.nullif(strip_ws(F.regexp_extract(_c(text), FENCE_RE, 1)), F.lit(""))


_MARKS = re.compile(r'[\\"{}]')


def _balanced(s: str | None) -> str | None:
    """First balanced {...} of the text; braces inside JSON strings do not count.

    Every brace opens a scan of its own, which starts outside of strings.  Scans that are both outside (or both
    inside) of a string stay together from there on, so one pass keeps two stacks of open braces: of the scans that
    are outside now, and of those inside.  Scans that come together are aligned by what is still open, and of two
    that will close together the first counts.
    """
    if s is None:
        return None
    outside: list[int] = []
    inside: list[int] = []
    escaped, first, best, end = -1, s.find("{"), len(s), 0
    if first < 0:
        return None
    for mark in _MARKS.finditer(s, first):
        i, ch = mark.start(), mark.group()
        if ch == "{":
            outside.append(i)
        elif ch == "}":
            if outside:
                start = outside.pop()
                if start < best:
                    best, end = start, i
                if start == first:
                    break
        elif ch == "\\":
            # outside of strings it is a character like others
            if escaped != i:
                escaped = i + 1
        elif escaped == i:
            # an escaped quote: scans inside stay, scans outside join them
            short, inside = sorted((inside, outside), key=len)
            for k in range(1, len(short) + 1):
                inside[-k] = min(inside[-k], short[-k])
            outside = []
        else:
            outside, inside = inside, outside
    return s[best:end + 1] if best < len(s) else None


@pandas_udf(StringType())
def balanced_object(texts: pd.Series) -> pd.Series:
    return texts.map(_balanced)


def json_from_text(df: DataFrame, col: str) -> DataFrame:
    """JSON out of model output: fenced block first, else the first balanced object.

    A top-level list becomes ``{"charts": list}``; failure fills ``json_error``,
    never raises.  The fence is a native regex; only texts without a usable fence
    go through the balanced scan (pandas UDF).
    """
    # step by step, so that no pattern or parse is evaluated twice
    steps = df.withColumn("_fenced", fenced_json(col)).withColumn("_fenced", F.when(F.try_parse_json("_fenced").isNotNull(), F.col("_fenced")))
    steps = steps.withColumn("_found", strip_ws(F.coalesce("_fenced", balanced_object(F.when(F.col("_fenced").isNull(), _c(col))))))
    steps = steps.withColumn("_json", F.when(F.col("_found").startswith("["), F.concat(F.lit('{"charts": '), "_found", F.lit("}"))).otherwise(F.col("_found")))
    steps = steps.withColumn("_json", F.when(F.try_parse_json("_json").isNotNull(), F.col("_json")))
    return steps.select(*[f"`{c}`" for c in df.columns if c not in ("json_text", "json_error")], F.col("_json").alias("json_text"),
                        F.when(F.col("_json").isNull(), F.lit("no valid JSON found")).alias("json_error"))


# --------------------------------------------------------------------------- T15
# A work-history date is YYYY-MM (1 or 2 digit month) or YYYY, or "Present".
DATE_RE = r"^([0-9]{4})(-([0-9]{1,2}))?$"


def month_index(s: Column, now: Column) -> Column:
    """'YYYY-MM' / 'YYYY' (= January) / 'Present' (= now) → months since year 0; NULL when unparsable.

    One pattern with two capture groups, so each date costs two lookups of the same compiled regex.
    """
    t = F.trim(s)
    y = F.regexp_extract(t, DATE_RE, 1)
    m = F.regexp_extract(t, DATE_RE, 3)
    return (
        F.when(F.lower(t) == "present", F.year(now) * 12 + F.month(now) - 1)
        .when(y != "", y.cast("int") * 12 + F.when(m != "", m.cast("int") - 1).otherwise(F.lit(0)))
    )


def experience_years(jobs: DataFrame, now: Column, person: str = "cv_id", start: str = "start_date",
                     end: str = "end_date") -> DataFrame:
    """Total experience per person: overlapping jobs merged, months counted once.

    Every job covers a range of months (inclusive; an open end is ``now``).  The union is
    counted with one 12-bit mask per (person, year): each job contributes the bits of the months
    it covers in each year it touches, ``bit_or`` merges overlapping jobs, ``bit_count`` counts
    months.  This is the gaps-and-islands result without a per-person sort, keyed by (person,
    year), so a person with a huge history is still spread over tasks and reduced map-side.
    """
    s = month_index(F.col(start), now)
    e = month_index(F.coalesce(F.col(end), F.lit("Present")), now)
    spans = jobs.select(F.col(person).alias(person), s.alias("_s"), e.alias("_e")).where(
        F.col("_s").isNotNull() & F.col("_e").isNotNull() & (F.col("_e") >= F.col("_s")))
    years = spans.select(person, "_s", "_e", F.explode(F.sequence(F.floor(F.col("_s") / 12).cast("int"),
                                                                   F.floor(F.col("_e") / 12).cast("int"))).alias("_y"))
    lo = F.greatest(F.col("_s"), F.col("_y") * 12) - F.col("_y") * 12
    hi = F.least(F.col("_e"), F.col("_y") * 12 + 11) - F.col("_y") * 12
    # bits lo..hi set: (2^(hi-lo+1) - 1) · 2^lo, exact in double for 12 bits
    mask = ((F.pow(F.lit(2.0), hi - lo + 1) - 1) * F.pow(F.lit(2.0), lo)).cast("long")
    per_year = years.groupBy(person, "_y").agg(F.bit_or(mask).alias("_m"))
    return per_year.groupBy(person).agg(F.sum(F.bit_count("_m")).cast("long").alias("months")).withColumn(
        "years", F.round(F.col("months") / 12.0, 1))


# --------------------------------------------------------------------------- T5
# Tag patterns of the HTML field extraction.
TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
H1_RE = r"(?is)<h1[^>]*>(.*?)</h1>"
LANG_RE = r"(?i)<html[^>]*\blang=\"([^\"]*)\""
HREF_RE = r"(?i)<a\b[^>]*\bhref=\"([^\"]*)\""
DROP_BLOCKS_RE = r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>"
TAG_RE = r"(?s)<[^>]+>"


@pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(lambda s: None if s is None else html.unescape(s))


def visible_text(html: Column) -> Column:
    """Tags stripped (script/style/noscript blocks dropped), one line per text node (native regex)."""
    no_blocks = F.regexp_replace(html, DROP_BLOCKS_RE, " ")
    lines = F.split(F.regexp_replace(no_blocks, TAG_RE, "\n"), "\n")
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(kept, "\n")


def html_fields(pages: DataFrame, url: str = "url", html: str = "html", decode: bool = True) -> DataFrame:
    """title, h1, lang, host, links and visible text of every page."""
    h = F.col(html)
    title = F.trim(F.regexp_extract(h, TITLE_RE, 1))
    text = visible_text(h)
    out = pages.withColumns({
        "title": F.nullif(title, F.lit("")),
        "h1": F.nullif(F.trim(F.regexp_replace(F.regexp_extract(h, H1_RE, 1), TAG_RE, "")), F.lit("")),
        "lang": F.nullif(F.regexp_extract(h, LANG_RE, 1), F.lit("")),
        "host": F.try_parse_url(F.col(url), F.lit("HOST")),
        "links": F.regexp_extract_all(h, F.lit(HREF_RE), 1),
        "text": text,
    })
    if decode:
        out = out.withColumns({"title": html_unescape(F.col("title")), "text": html_unescape(F.col("text"))})
    return out
