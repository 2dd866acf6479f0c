"""V: vector knowledge base — embedding replies, indexing, exact top-k, context (tables and index: vector_store.py).

Exact search (V3) is a block matrix product over a grid of vector and query
blocks (cogrouped, one cell a group): a cell keeps only the k best per query, and
a final ``row_number() <= k`` per query merges the partial top-k lists.  No query
× vector pair ever becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --------------------------------------------------------------------------- V1
def unwrap_embedding(df: DataFrame, col: str, out: str = "embedding") -> DataFrame:
    """Embedding reply JSON ``[[[v]]]`` → v, ``[[v]]`` → v, ``[v]`` → v (first token, no pooling)."""
    t = F.col(col)
    depth3 = t.rlike(r"^\s*\[\s*\[\s*\[")
    depth2 = t.rlike(r"^\s*\[\s*\[")
    v = (
        F.when(depth3, F.from_json(t, "array<array<array<double>>>")[0][0])
        .when(depth2, F.from_json(t, "array<array<double>>")[0])
        .otherwise(F.from_json(t, "array<double>"))
    )
    return df.withColumn(out, v)


# --------------------------------------------------------------------------- V2
def hashed_tfidf(docs: DataFrame, text: str, num_features: int = 256) -> DataFrame:
    """Default embedder: hashed term frequencies × IDF, L2-normalised (Spark ML, distributed fit)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer

    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[^\p{L}\p{N}]+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0),
    ])
    from pyspark.ml.functions import vector_to_array

    model = pipe.fit(docs)
    return model.transform(docs).withColumn("vector", vector_to_array("_vec", "float32")).drop(
        "_tok", "_tf", "_tfidf", "_vec")


def pandas_embedder(fn: Callable[[list[str]], np.ndarray], dims: int) -> Callable[[DataFrame, str], DataFrame]:
    """Wrap a batch embedding function (e.g. an ONNX model) as a ``mapInPandas`` embedder hook."""

    def embed(docs: DataFrame, text: str) -> DataFrame:
        from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

        schema = StructType(docs.schema.fields + [StructField("vector", ArrayType(FloatType()))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                vecs = fn(pdf[text].fillna("").tolist()) if len(pdf) else np.zeros((0, dims))
                pdf = pdf.copy()
                pdf["vector"] = [np.asarray(v, dtype=np.float32) for v in vecs]
                yield pdf

        return docs.mapInPandas(run, schema)

    return embed


def index_vectors(docs: DataFrame, key: str, text: str, timestamp: Column, metadata: Column | None = None,
                  embed: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Vector records (key, vector float32, metadata map): metadata = {text, timestamp} overlaid
    by the given metadata map — given keys win."""
    emb = (embed or hashed_tfidf)(docs, text)
    base = F.map_from_arrays(F.array(F.lit("text"), F.lit("timestamp")),
                             F.array(F.col(text), timestamp.cast("string")))
    if metadata is None:
        meta = base
    else:
        given = metadata
        keep = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(given), k))
        meta = F.map_concat(keep, given)
    return emb.select(F.col(key).alias("key"), F.col("vector"), meta.alias("metadata"))


# --------------------------------------------------------------------------- V3
def _normalise(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def vector_faults(vectors: DataFrame, dims: int, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(vec_id, reason) of the rows that search leaves out: no vector, NULL inside, another length."""
    v = F.col(vec)
    reason = (F.when(v.isNull(), "no vector").when(F.size(v) != dims, "wrong length")
              .when(F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double"))), "missing value"))
    return vectors.select(F.col(vec_id).alias("vec_id"), reason.alias("reason")).where("reason IS NOT NULL")


def usable_vectors(df: DataFrame, key: str, vec: str, dims: int | None = None,
                   out: tuple[str, str] = ("vec_id", "embedding")) -> tuple[DataFrame, int]:
    """(rows with a whole vector of ``dims`` numbers, dims); by default the most frequent length."""
    if dims is None:
        top = df.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("d")).count().orderBy(F.col("count").desc(), "d").first()
        dims = top["d"] if top else 0
    return _usable(df, key, vec, dims, out), dims


def _usable(df: DataFrame, key: str, vec: str, dims: int, out: tuple[str, str]) -> DataFrame:
    v = F.col(vec)
    good = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(key).alias(out[0]), v.cast("array<double>").alias(out[1]))


def score_cell(k: int, digits: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best (and ties) of a cell's vectors for each of its queries, as one matrix product."""
    def cell(v: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if v.empty or qs.empty:
            return pd.DataFrame({"query_id": qs["query_id"][:0], "vec_id": v["vec_id"][:0], "distance": np.zeros(0)})
        matrix, vec_ids, parts = _normalise(np.stack(v["embedding"].to_numpy())), v["vec_id"].to_numpy(), []
        for at in range(0, len(qs), 512):
            block = qs.iloc[at:at + 512]
            dist = np.round(1.0 - _normalise(np.stack(block["query"].to_numpy())) @ matrix.T, digits)
            kk = min(k, len(v))
            # everything up to the k-th smallest distance (ties included), so the final ranking is exact
            qi, vi = np.nonzero(dist <= np.partition(dist, kk - 1, axis=1)[:, kk - 1:kk])
            part = pd.DataFrame({"query_id": block["query_id"].to_numpy()[qi], "vec_id": vec_ids[vi], "distance": dist[qi, vi]})
            parts.append(part.sort_values(["query_id", "distance", "vec_id"]).groupby("query_id").head(k))
        return pd.concat(parts)

    return cell


def knn(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", query_vec: str = "query",
        vec_id: str = "vec_id", vec: str = "embedding", where: Column | None = None, digits: int = 6,
        cell_vectors: int = 20_000, cell_queries: int = 2_000) -> DataFrame:
    """Exact top-k by cosine distance for many queries at once.

    Output: query_id, vec_id, distance (= 1 − cosine, rounded to ``digits``), score (1 − distance), rank.
    Ranking is by (rounded distance, vec_id), so ties are broken deterministically.

    Vectors and queries are dealt into a grid: a cell holds about ``cell_vectors`` vectors and
    ``cell_queries`` queries, is multiplied as one matrix product and returns the k best (and ties) of
    each of its queries.  A vector goes to as many cells as there are query blocks and the other way
    round; nothing passes the driver, and a task holds one cell (20000 x 64 and 512 x 20000 doubles by
    default, about 100 MB).  Rows without a usable vector are left out (``vector_faults`` lists them).
    """
    if k <= 0:
        raise ValueError("k must be > 0")
    vs = vectors.where(where) if where is not None else vectors
    vs, dims = usable_vectors(vs, vec_id, vec)
    q = _usable(queries, query_id, query_vec, dims, ("query_id", "query"))
    rows = max(1, -(-vs.count() // cell_vectors))
    cols = max(1, -(-q.count() // cell_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vs.withColumn("r", F.pmod(F.xxhash64("vec_id"), F.lit(rows)).cast("int")).withColumn("c", every(cols))
    right = q.withColumn("c", F.pmod(F.xxhash64("query_id"), F.lit(cols)).cast("int")).withColumn("r", every(rows))
    out_schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, vec_id {vs.schema['vec_id'].dataType.simpleString()}, distance double"

    cell = score_cell(k, digits)
    cand = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(lambda v, qs: cell(v, qs), out_schema)
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc(), F.col("vec_id").asc())
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("score", F.round(1 - F.col("distance"), digits))
            .select("query_id", "vec_id", "distance", "score", "rank"))


def centroids(vectors: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per group (per-dimension average, partial aggregation); dims are bounded."""
    e = vectors.select(F.col(group).alias("query_id"), F.posexplode(vec).alias("pos", "x"))
    m = e.groupBy("query_id", "pos").agg(F.avg("x").alias("x"))
    return m.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_v")).select(
        "query_id", F.transform("_v", lambda s: s["x"]).alias("query"))


# --------------------------------------------------------------------------- V5
def retrieve_context(hits: DataFrame, items: str, per_hit: int = 3, total: int = 10, header: str = "",
                     fallback: str = "", bullet: str = "• ", query_id: str = "query_id", rank: str = "rank",
                     distinct: bool = False) -> DataFrame:
    """Flatten list metadata of ranked hits into prompt context.

    Takes ``per_hit`` items of each hit in rank order, ``total`` in all; ``distinct`` then keeps the
    first occurrence of each of these.  No items → ``fallback``.  Per query only ``total`` rows are ever collected.
    """
    ex = hits.select(query_id, rank, F.posexplode(F.slice(F.col(items), 1, per_hit)).alias("pos", "item"))
    w = Window.partitionBy(query_id).orderBy(rank, "pos")
    top = ex.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= total)
    if distinct:
        top = top.groupBy(query_id, "item").agg(F.min("_n").alias("_n"))
    agg = top.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("_n", "item"))).alias("_i")).select(
        query_id, F.transform("_i", lambda s: s["item"]).alias("items"))
    qs = hits.select(query_id).distinct()
    out = qs.join(agg, query_id, "left")
    n = F.coalesce(F.size("items"), F.lit(0))
    text = F.when(n > 0, F.concat(F.lit(header), F.array_join(F.transform("items", lambda x: F.concat(F.lit(bullet), x)), "\n"))
                  ).otherwise(F.lit(fallback))
    return out.select(query_id, n.alias("n_items"), text.alias("context"))
