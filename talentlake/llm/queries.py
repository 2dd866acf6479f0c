"""Registered queries of the training-data operators and their DuckDB SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentlake.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@_query("op2_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talentlake.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talentlake.llm.language import fit_language, held_out, identify_language

    docs = documents(spark, sf_dir)
    found = identify_language(docs.select("doc_id", "text"), fit_language(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score",
                        "language.rejected")


@_query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talentlake.llm.quality import classify_quality

    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = classify_quality(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return scored.select("doc_id", "held_out", "score", "predicted")


PII_KEY = "talentlake-release-key"


@_query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talentlake.llm.pii import pseudonymise

    docs = documents(spark, sf_dir).select("doc_id", "text")
    new = pseudonymise(docs, PII_KEY)
    return new.select("doc_id", F.size("pii_matches").cast("long").alias("n_found"), "text")


def tokenizer_path() -> str:
    """Place of the public byte-level BPE file on this machine (every executor has the package)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PACKED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@_query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talentlake.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer_path()).select(*PACKED)


@_query("op7_jaccard")
def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talentlake.llm.jaccard import jaccard_components

    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@_query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_bytes`` is the input's length; ``text`` is what stays, with U+FFFD for what is left of a cut character."""
    from talentlake.llm.suffix_dedup import remove_repeats

    cut = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans",
                      F.sha2("repeats.kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("repeats.kept").cast("string")).alias("text"))


@_query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and what they decode to.  The public model file has merge ranks, no log scores."""
    import public_tokenizers

    from talentlake.llm.unigram import UnigramModel, decode_documents, encode_documents

    model = UnigramModel.from_file(public_tokenizers.path("piece_bpe_32k.model"), ranked=True)
    ids = encode_documents(documents(spark, sf_dir).select("doc_id", "text"), model)
    back = decode_documents(ids, model)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


TRAINING_KEY = 20240229


@_query("op5_training_order")
def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence with its documents, and the checksum of its record as read from the shards."""
    from talentlake.llm.order import materialise, read_slots

    made = materialise(documents(spark, sf_dir), tokenizer_path(), TRAINING_KEY)
    records = read_slots(spark, made).select("slot", F.crc32("ids").alias("ids_crc32"))
    return made.sequences.join(records, "slot").select("slot", "shard", "n_tokens", "doc_ids", "ids_crc32")


@_query("op8_top_k")
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100, as a query with its whole text."""
    from talentlake.llm.search import top_k

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return top_k(docs, docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))


FITTED = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens")


@_query("op11_best_fit")
def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talentlake.llm.best_fit import Capacity, pack_whole

    return pack_whole(documents(spark, sf_dir), tokenizer_path(), Capacity(2048)).select(*FITTED)


@_query("op13_divergence", r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM d),
t AS (
  SELECT rid, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS kept, sum(n) AS total FROM k GROUP BY lang),
g AS (
  SELECT o.lang, o.source, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN c ON c.lang = o.lang AND c.source = o.source GROUP BY o.lang, o.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + v.kept) AS p,
         1 + 1000000000::HUGEINT * (k.n + 1) // (v.total + v.kept) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 200
""")
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talentlake.llm.divergence import audit

    return audit(documents(spark, sf_dir))


REPAIRED = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@_query("op12_repair")
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talentlake.llm.repair import damaged_and_repaired

    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return damaged_and_repaired(table).select(*REPAIRED)
