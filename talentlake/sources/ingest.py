"""A: ingestion sources — knowledge documents, admission gates, files and batch messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.functions.columns import role_from_slug

# Defaults of the knowledge documents when a field is missing.
DEFAULT_GENERAL = "general"
DEFAULT_IMPACT = "qualitative"
DEFAULT_TESTING = "Various skills"
DEFAULT_STRUCTURE = "Use STAR method."

BULLETS_SCHEMA = "role_category STRING, bullets ARRAY<STRUCT<text: STRING, skill_area: STRING, impact_type: STRING>>"
INTERVIEWS_SCHEMA = ("category STRING, questions ARRAY<STRUCT<topic: STRING, question: STRING, "
                     "what_theyre_testing: STRING, good_answer_structure: STRING>>")
GUIDES_SCHEMA = ("industry STRING, role STRING, must_have_keywords ARRAY<STRING>, "
                 "nice_to_have_keywords ARRAY<STRING>, tips ARRAY<STRING>")


def read_knowledge_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Read one kind of knowledge JSON files (one object per file) with its fixed schema.

    ``source_file`` comes from the hidden ``_metadata`` column, no driver listing.
    """
    schema = {"bullets": BULLETS_SCHEMA, "interviews": INTERVIEWS_SCHEMA, "guides": GUIDES_SCHEMA}[kind]
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def _g(c: Column) -> Column:
    return F.coalesce(c, F.lit(DEFAULT_GENERAL))


# --------------------------------------------------------------------------- A2
def knowledge_docs(bullets: DataFrame | None, interviews: DataFrame | None, guides: DataFrame | None) -> DataFrame:
    """Explode the three guide kinds into one document table.

    Output: source_file, pos, type, text, category, subcategory, impact_type.
    """
    parts = []
    if bullets is not None:
        b = bullets.select("source_file", _g(F.col("role_category")).alias("category"),
                           F.posexplode("bullets").alias("pos", "b"))
        parts.append(b.select(
            "source_file", "pos", F.lit("cv_bullet_template").alias("type"),
            F.concat(F.lit("CV bullet example for "), role_from_slug(F.col("category")), F.lit(": "),
                     F.col("b.text")).alias("text"),
            "category", _g(F.col("b.skill_area")).alias("subcategory"),
            F.coalesce(F.col("b.impact_type"), F.lit(DEFAULT_IMPACT)).alias("impact_type")))
    if interviews is not None:
        q = interviews.select("source_file", _g(F.col("category")).alias("category"),
                              F.posexplode("questions").alias("pos", "q"))
        parts.append(q.select(
            "source_file", "pos", F.lit("interview_question").alias("type"),
            F.concat(F.lit("Interview question ("), F.col("category"), F.lit("): "), F.col("q.question"),
                     F.lit(". What they're testing: "), F.coalesce(F.col("q.what_theyre_testing"), F.lit(DEFAULT_TESTING)),
                     F.lit(". Good answer structure: "),
                     F.coalesce(F.col("q.good_answer_structure"), F.lit(DEFAULT_STRUCTURE))).alias("text"),
            "category", _g(F.col("q.topic")).alias("subcategory"), F.lit(None).cast("string").alias("impact_type")))
    if guides is not None:
        def joined(c, sep):
            return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), sep)
        parts.append(guides.select(
            "source_file", F.lit(0).alias("pos"), F.lit("ats_keyword_guide").alias("type"),
            F.concat(F.lit("ATS keyword guide for "), role_from_slug(_g(F.col("role"))), F.lit(" in "),
                     _g(F.col("industry")), F.lit(". Must-have keywords: "), joined("must_have_keywords", ", "),
                     F.lit(". Nice-to-have keywords: "), joined("nice_to_have_keywords", ", "),
                     F.lit(". Tips: "), joined("tips", " ")).alias("text"),
            _g(F.col("role")).alias("category"), _g(F.col("industry")).alias("subcategory"),
            F.lit(None).cast("string").alias("impact_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --------------------------------------------------------------------------- A3
def admit_documents(df: DataFrame, text_col: str = "text", min_len: int = 50, kind: str = "posting") -> DataFrame:
    """Admission gate: trimmed text must have at least ``min_len`` characters (50 posting/pasted CV, 100 upload)."""
    n = F.length(F.trim(F.col(text_col)))
    reason = F.when(F.col(text_col).isNull(), F.lit("missing")).when(n < min_len, F.lit("too_short"))
    return df.withColumns({"kind": F.lit(kind), "admitted": reason.isNull(), "reject_reason": reason})


# --------------------------------------------------------------------------- A4
MAX_FILE_MB = 5.0
MIN_FILE_BYTES = 100
PDF_MAGIC = "%PDF"


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Binary file source (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def admit_files(files: DataFrame, max_mb: float = MAX_FILE_MB, content: str = "content",
                length: str = "length") -> DataFrame:
    """File gate, first failing rule wins: larger than ``max_mb`` MB, no PDF magic, under 100 bytes."""
    size = F.col(length)
    magic = F.substring(F.col(content), 1, 4) == F.lit(PDF_MAGIC.encode()).cast("binary")
    reason = (
        F.when(size > int(max_mb * 1024 * 1024), F.lit("too_large"))
        .when(~magic, F.lit("not_pdf"))
        .when(size < MIN_FILE_BYTES, F.lit("too_small"))
    )
    return files.withColumns({"admitted": reason.isNull(), "reject_reason": reason})


def gate_files(spark: SparkSession, path: str, glob: str = "*.pdf", max_mb: float = MAX_FILE_MB) -> DataFrame:
    """``admit_files`` over files as they lie: path, modificationTime, length, admitted, reject_reason, and the
    content of admitted files.

    The size is judged by the listing.  Content is read only for files inside the bound (``length`` is pushed
    down to the file source, which then does not open the others), so a file of any size can be there.
    Spark's file source does not list files of 0 bytes: they give no row.
    """
    limit = int(max_mb * 1024 * 1024)
    files = read_files(spark, path, glob)
    inside = admit_files(files.where(F.col("length") <= limit), max_mb).withColumn("content", F.when(F.col("admitted"), F.col("content")))
    beyond = files.where(F.col("length") > limit).select(
        "path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"), F.lit(False).alias("admitted"),
        F.lit("too_large").alias("reject_reason"))
    return inside.unionByName(beyond)


# --------------------------------------------------------------------------- A12
BATCH_SCHEMA = ("batch ARRAY<STRUCT<type: STRING, text: STRING, user_id: STRING, "
                "cv_version_id: STRING, job_posting_id: STRING>>")


def route_batch(messages: DataFrame, body: str = "body", message_id: str = "message_id") -> DataFrame:
    """Explode a batch message, route items by type (cv / job); other types and empty text are error rows.

    Output keeps input order: (message_id, pos, type, route, error, text).
    """
    parsed = messages.select(message_id, F.from_json(F.col(body), BATCH_SCHEMA).alias("_m"))
    items = parsed.select(message_id, F.posexplode_outer("_m.batch").alias("pos", "item"))
    t = F.col("item.type")
    empty = F.coalesce(F.trim(F.col("item.text")), F.lit("")) == ""
    route = F.when(t.isin("cv", "job") & ~empty, t)
    error = (
        F.when(F.col("item").isNull(), F.lit("empty batch"))
        .when(~F.coalesce(t.isin("cv", "job"), F.lit(False)), F.concat(F.lit("unknown type: "), F.coalesce(t, F.lit("null"))))
        .when(empty, F.lit("empty text"))
    )
    return items.select(message_id, "pos", t.alias("type"), route.alias("route"), error.alias("error"),
                        F.col("item.text").alias("text"))
