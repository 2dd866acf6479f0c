"""Registered queries for the V operators (vector knowledge base)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talentlake.operators import vector_store as VS
from talentlake.operators import vectors as VX
from talentlake.plans.oracle_views import with_views as W
from talentlake.plans.q_ingest import knowledge_inputs
from talentlake.plans.registry import ORACLES, register
from talentlake.session import scratch_path
from talentlake.sources import ingest as I
from talentlake.sources.tables import Tables


def _replies(t):
    """Embedding service replies as JSON text, nested 3, 2 or 1 deep."""
    e = t.embeddings
    j = F.to_json(F.col("embedding"))
    depth = F.col("vec_id") % 3
    return e.select("vec_id", F.when(depth == 0, F.concat(F.lit("[["), j, F.lit("]]")))
                    .when(depth == 1, F.concat(F.lit("["), j, F.lit("]"))).otherwise(j).alias("reply"))


@register("unwrap_embedding", """
SELECT vec_id, CAST(len(v) AS INT) AS dims, v AS embedding FROM (
  SELECT vec_id, CASE WHEN regexp_matches(reply, '^\\s*\\[\\s*\\[\\s*\\[') THEN CAST(reply AS DOUBLE[][][])[1][1]
                      WHEN regexp_matches(reply, '^\\s*\\[\\s*\\[') THEN CAST(reply AS DOUBLE[][])[1]
                      ELSE CAST(reply AS DOUBLE[]) END AS v
  FROM (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN '[[' || CAST(embedding AS VARCHAR) || ']]'
                                       WHEN 1 THEN '[' || CAST(embedding AS VARCHAR) || ']'
                                       ELSE CAST(embedding AS VARCHAR) END AS reply FROM embeddings))""")
def q_unwrap_embedding(spark, d):
    u = VX.unwrap_embedding(_replies(Tables(spark, d)), "reply")
    return u.select("vec_id", F.size("embedding").alias("dims"), "embedding")


@register("index_vectors", W([], """
SELECT source_file || ':' || pos AS key, text, '2024-01-01 00:00:00' AS timestamp, type, category, source_file, CAST(256 AS INT) AS dims,
  true AS unit_norm FROM kd""", extra=[("kd", ORACLES["knowledge_docs"])]))
def q_index_vectors(spark, d):
    """Keys, metadata, dimensions and whether the vector has length one."""
    b, i, g = knowledge_inputs(Tables(spark, d))
    docs = I.knowledge_docs(b, i, g).withColumn("key", F.concat_ws(":", "source_file", F.col("pos").cast("string")))
    meta = F.map_from_arrays(F.array(F.lit("type"), F.lit("category"), F.lit("source_file")),
                             F.array("type", "category", "source_file"))
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    v = VX.index_vectors(docs, "key", "text", ts, meta)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("key", *[F.col("metadata")[c].alias(c) for c in ("text", "timestamp", "type", "category", "source_file")],
                    F.size("vector").alias("dims"), (F.abs(norm - 1) < 1e-5).alias("unit_norm"))


CENTROID_SQL = """
SELECT label AS query_id, list(x ORDER BY pos) AS q FROM (
  SELECT label, pos, avg(x) AS x FROM (
    SELECT label, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings)
  GROUP BY label, pos) GROUP BY label"""

KNN_SQL = W([], """
SELECT query_id, vec_id, distance, round(1 - distance, 6) AS score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INT) AS rank FROM (
    SELECT c.query_id, e.vec_id, round(1 - list_cosine_similarity(c.q, CAST(e.embedding AS DOUBLE[])), 6) AS distance
    FROM c, embeddings e))
WHERE rank <= 5""", extra=[("c", CENTROID_SQL)])


def _knn(spark, d):
    e = Tables(spark, d).embeddings
    return VX.knn(VX.centroids(e, "label"), e, 5)


@register("knn", KNN_SQL)
def q_knn(spark, d):
    return _knn(spark, d)


@register("knn_approx", """
SELECT label AS query_id, CAST(20 AS BIGINT) AS n, true AS recalled FROM embeddings WHERE label IS NOT NULL GROUP BY label""")
def q_knn_approx(spark, d):
    """Rows for each query out of the inverted lists, and whether nine of ten exact neighbours (of all queries) are among them."""
    e = Tables(spark, d).embeddings
    q = VX.centroids(e, "label")
    exact = VX.knn(q, e, 20).select("query_id", "vec_id", F.lit(1).alias("hit"))
    near = VS.knn_approx(q, e, 20).join(exact, ["query_id", "vec_id"], "left")
    per = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    everywhere = Window.partitionBy()  # a row per query
    return per.select("query_id", "n", (F.sum("hits").over(everywhere) >= 0.9 * 20 * F.count(F.lit(1)).over(everywhere)).alias("recalled"))


@register("vector_puts", """
SELECT CAST(vec_id AS VARCHAR) AS key, CASE WHEN vec_id % 14 = 0 THEN 3 WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END AS version,
  CASE WHEN vec_id % 14 = 0 THEN 'again' WHEN vec_id % 5 = 0 THEN 'changed' ELSE 'first' END AS stage, CAST(label AS VARCHAR) AS label,
  CAST(len(embedding) AS INT) AS dims, round(CAST(CASE WHEN vec_id % 5 = 0 AND vec_id % 14 <> 0 THEN embedding[-1] ELSE embedding[1] END AS DOUBLE), 5) AS head
FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 14 = 0""")
def q_vector_puts(spark, d):
    """All vectors are put, a fifth is overwritten, a seventh deleted, and half of those put again."""
    e, table = Tables(spark, d).embeddings, VS.VectorTable(spark, scratch_path(spark, "vector-table"), compact_every=2)
    key = F.col("vec_id").cast("string").alias("key")

    def records(df, stage, vector):
        meta = F.map_from_arrays(F.array(F.lit("stage"), F.lit("label")), F.array(F.lit(stage), F.col("label").cast("string")))
        return df.select(key, vector.alias("vector"), meta.alias("metadata"))

    table.put(records(e, "first", F.col("embedding")))
    table.put(records(e.where("vec_id % 5 = 0"), "changed", F.reverse("embedding")))
    table.delete(e.where("vec_id % 7 = 0").select(key))
    table.put(records(e.where("vec_id % 14 = 0"), "again", F.col("embedding")))
    return table.table().select("key", F.col("version").cast("int").alias("version"), F.col("metadata.stage").alias("stage"),
                                F.col("metadata.label").alias("label"), F.size("vector").alias("dims"),
                                F.round(F.col("vector")[0].cast("double"), 5).alias("head"))


@register("retrieve_context", W([], """
SELECT query_id, CAST(len(items) AS INT) AS n_items,
  CASE WHEN len(items) > 0 THEN 'Example strong bullets:' || chr(10) ||
       array_to_string(list_transform(items, lambda x: '• ' || x), chr(10))
       ELSE 'No templates available' END AS context
FROM (SELECT h.query_id, coalesce(list(item ORDER BY n) FILTER (WHERE item IS NOT NULL AND n <= 10), []) AS items
      FROM (SELECT DISTINCT query_id FROM k) h LEFT JOIN (
        SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS n FROM (
          SELECT query_id, rank, unnest(generate_series(0, least(len(bl), 3) - 1)) AS pos,
                 unnest(bl[1:3]) AS item FROM (
            SELECT query_id, rank, list_transform(generate_series(1, CAST(vec_id % 5 AS BIGINT)),
                     lambda i: 'tip ' || CAST(vec_id AS VARCHAR) || '-' || CAST(i AS VARCHAR)) AS bl FROM k))) x
      ON h.query_id = x.query_id GROUP BY h.query_id)""", extra=[("k", KNN_SQL)]))
def q_retrieve_context(spark, d):
    hits = _knn(spark, d)
    n = (F.col("vec_id") % 5).cast("int")
    hits = hits.withColumn("bullets", F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.lit("tip "), F.col("vec_id").cast("string"), F.lit("-"), i.cast("string")))).otherwise(
        F.array().cast("array<string>")))
    return VX.retrieve_context(hits, "bullets", per_hit=3, total=10, header="Example strong bullets:\n",
                               fallback="No templates available")
