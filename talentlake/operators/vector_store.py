"""V2 and V4 at rest: a keyed table of vectors, and an inverted-file index for approximate search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talentlake.operators.vectors import knn, score_cell, usable_vectors
from talentlake.session import scratch_path
from talentlake.streaming.tables import BatchLog, bases, finished


# --------------------------------------------------------------------------- V2
class VectorTable:
    """Vector records (key, vector, metadata) under ``path``: a put overwrites by key, a delete removes.

    Puts and deletes are versions: each writes its own rows, in order, and readers take the last of each key.
    A version that is written again (a retry) replaces itself.  Every ``compact_every`` versions the table is
    written anew in ``buckets`` hash folders, without deleted keys; ``get`` reads the folders its keys are in.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, compact_every: int = 16):
        schema = StructType.fromDDL("key STRING, vector ARRAY<FLOAT>, metadata MAP<STRING, STRING>, deleted BOOLEAN, version LONG")
        self.spark = spark
        self.log = BatchLog(spark, path, schema, self._last, "key", buckets, compact_every, lambda t: t.where("NOT deleted"))

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct("vector", "metadata", "deleted", "version"), F.col("version"))
        return rows.groupBy("key").agg(last.alias("r")).select("key", "r.*")

    def next_version(self) -> int:
        known = [*bases(self.spark, self.log.path), *finished(self.spark, f"{self.log.path}/log", "_batch")]
        return max(known, default=-1) + 1

    def _write(self, rows: DataFrame, version: int | None) -> int:
        version = self.next_version() if version is None else version
        self.log.write(rows.withColumn("version", F.lit(version).cast("long")), version)
        self.log.compact(version)
        return version

    def put(self, records: DataFrame, order: Column | None = None, version: int | None = None) -> int:
        """Insert or overwrite ``records``; of a key that comes more than once the last by ``order`` (by default by
        its content, so that a retry takes the same one).  Records without key are refused.  Returns the version."""
        rows = records.select("key", F.col("vector").cast("array<float>").alias("vector"), "metadata",
                              (F.xxhash64("vector", F.map_entries("metadata")) if order is None else order).alias("_o"))
        if not rows.where("key IS NULL").isEmpty():
            raise ValueError("a record has no key")
        one = rows.groupBy("key").agg(F.max_by(F.struct("vector", "metadata"), F.col("_o")).alias("r"))
        return self._write(one.select("key", "r.*", F.lit(False).alias("deleted")), version)

    def delete(self, keys: DataFrame, version: int | None = None) -> int:
        gone = keys.select("key").where("key IS NOT NULL").distinct()
        return self._write(gone.select("key", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("map<string,string>").alias("metadata"),
                                       F.lit(True).alias("deleted")), version)

    def table(self) -> DataFrame:
        """key, vector, metadata, version of all live records."""
        return self.log.table().where("NOT deleted").drop("deleted")

    def get(self, keys: DataFrame) -> DataFrame:
        return self.log.table(only=keys.select("key").distinct()).where("NOT deleted").drop("deleted")


# --------------------------------------------------------------------------- V4
class IvfIndex:
    """Inverted-file index under ``path``: unit vectors in lists by their nearest of a few coarse centres.

    Every vector is in one list; a search reads the lists nearest to its queries only and ranks what is in them
    exactly.  The centres (at most ``MAX_LISTS`` vectors) are the one thing that the driver holds.
    """

    MAX_LISTS = 4096

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["list"])
        self.centres = np.array([r["centre"] for r in rows], float)
        self.probes, self.kind = rows[0]["probes"], rows[0]["kind"]

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, vec_id: str = "vec_id", vec: str = "embedding", lists: int | None = None,
              sample_per_list: int = 64, k: int = 10, recall: float = 0.95, calibrate_with: int = 128, seed: int = 7) -> IvfIndex:
        """Index all usable ``vectors`` (see ``vector_faults``).

        Centres: k-means over a bounded sample (``sample_per_list`` vectors a list, those of smallest hash);
        by default the square root of the number of vectors, at most ``MAX_LISTS``.  Probes: for ``calibrate_with``
        of the vectors as queries the ``k`` exact neighbours are found, and as many lists are probed by default
        as hold the share ``recall`` of them.
        """
        spark = vectors.sparkSession
        path = path or scratch_path(spark, "ivf")
        unit, dims = usable_vectors(vectors, vec_id, vec)
        total = unit.count()
        n_lists = min(cls.MAX_LISTS, lists or max(1, int(np.ceil(np.sqrt(total)))))
        points = unit.withColumn("_unit", array_to_vector(_unit_vector(F.col("embedding"), dims)))
        some = points.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id")
        centres = np.zeros((1, max(dims, 1)))
        indexed = points.withColumn("list", F.lit(0))
        if total > 1 and n_lists > 1:
            sample = some.limit(sample_per_list * n_lists).select("_unit")
            model = KMeans(featuresCol="_unit", predictionCol="list", k=n_lists, maxIter=8, seed=seed).fit(sample)
            centres = np.array(model.clusterCenters())
            indexed = model.transform(points)
        # a list that holds most vectors is written by several tasks
        spread = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // len(centres))))
        (indexed.select("vec_id", "embedding", "list").repartition("list", spread).write.partitionBy("list").parquet(f"{path}/vectors"))
        probes = len(centres)
        if total > 1 and len(centres) > 1:
            queries = some.limit(calibrate_with).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
            near = knn(queries, unit, k + 1).where("query_id <> vec_id")
            where = spark.read.parquet(f"{path}/vectors").select("vec_id", "list")
            order = queries.select("query_id", _nearest_lists(centres, len(centres))("query").alias("order"))
            place = near.join(where, "vec_id").join(order, "query_id").select(F.array_position("order", F.col("list").cast("int")).alias("place"))
            probes = int(place.agg(F.percentile_approx("place", recall)).first()[0] or probes)
        kind = unit.schema["vec_id"].dataType.simpleString()
        rows = [(i, c.tolist(), probes, kind) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "list INT, centre ARRAY<DOUBLE>, probes INT, kind STRING").coalesce(1).write.parquet(f"{path}/centres")
        return cls(spark, path)

    def lists(self) -> DataFrame:
        # the schema is given: an index of no vectors has no files
        return self.spark.read.schema(f"vec_id {self.kind}, embedding ARRAY<DOUBLE>, list INT").parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, query_id: str = "query_id", query_vec: str = "query",
               digits: int = 6, cell_vectors: int = 20_000, cell_queries: int = 2_000) -> DataFrame:
        """query_id, vec_id, distance, rank: the k best of the lists probed (``probes`` nearest ones).

        A list and the queries that probe it are dealt into cells of bounded size, each one matrix product, so
        neither a list with most vectors nor one that every query probes is one task.  Queries that found fewer than
        k (their lists hold fewer) are searched in all lists, so every query gets k rows where there are k vectors.
        """
        spark, n_lists = self.spark, len(self.centres)
        probes = min(n_lists, probes or self.probes)
        vectors = self.lists()
        asked, _ = usable_vectors(queries, query_id, query_vec, self.centres.shape[1], ("query_id", "query"))
        path = scratch_path(spark, "ivf-search")
        probed = asked.withColumn("list", F.explode(_nearest_lists(self.centres, probes)("query")))
        probed.write.parquet(f"{path}/probed")
        probed = spark.read.parquet(f"{path}/probed")
        share = lambda df, n: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias("n"))
        per_list = {r["list"]: r["n"] for r in share(probed, cell_queries).collect()}  # at most ``MAX_LISTS`` rows, as below
        vectors = vectors.where(F.col("list").isin(list(per_list)))  # the folders that are read
        slices = {r["list"]: r["n"] for r in share(vectors, cell_vectors).collect()}
        grid = spark.createDataFrame([(i, n, per_list[i]) for i, n in slices.items()] or [(-1, 1, 1)], "list INT, rows INT, cols INT")
        grid = F.broadcast(grid)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        left = vectors.join(grid, "list").select("vec_id", "embedding", "list", part("vec_id", "rows").alias("r"), every("cols").alias("c"))
        right = probed.join(grid, "list").select("query_id", "query", "list", part("query_id", "cols").alias("c"), every("rows").alias("r"))
        kinds = [df.schema[c].dataType.simpleString() for df, c in ((asked, "query_id"), (vectors, "vec_id"))]
        cell = score_cell(k, digits)
        cand = left.groupBy("list", "r", "c").cogroup(right.groupBy("list", "r", "c")).applyInPandas(
            lambda v, q: cell(v, q), f"query_id {kinds[0]}, vec_id {kinds[1]}, distance double")
        best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        (cand.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
         .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).write.parquet(f"{path}/near"))
        near = spark.read.parquet(f"{path}/near")
        found = near.where(F.col("n") >= k).select("query_id", "vec_id", "distance", "rank")
        short = asked.join(found.select("query_id").distinct(), "query_id", "left_anti")
        if probes == n_lists or short.isEmpty():
            return near.select("query_id", "vec_id", "distance", "rank")
        rest = knn(short, self.lists(), k, digits=digits).select("query_id", "vec_id", "distance", "rank")
        return found.unionByName(rest)


def _unit_vector(v: Column, dims: int) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))
    # a vector of the right size in any case: Spark may compute rows before it filters them
    return F.coalesce(F.when(F.size(v) == dims, unit), F.array_repeat(F.lit(0.0), dims))


def _nearest_lists(centres: np.ndarray, n: int):
    """Numbers of the ``n`` nearest centres, nearest first."""
    offset = (centres ** 2).sum(1)

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        v = np.stack(vectors.to_numpy()).astype(float)
        length = np.linalg.norm(v, axis=1, keepdims=True)
        length[length == 0] = 1.0
        order = np.argsort(offset - 2 * (v / length) @ centres.T, axis=1, kind="stable")[:, :n].astype(np.int32)
        return pd.Series(list(order))

    return nearest


def knn_approx(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", query_vec: str = "query",
               vec_id: str = "vec_id", vec: str = "embedding", probes: int | None = None, **options) -> DataFrame:
    """Approximate top-k: an index over ``vectors`` and one search in it (keep the ``IvfIndex`` for more)."""
    index = IvfIndex.build(vectors, None, vec_id, vec, k=k, **options)
    return index.search(queries, k, probes, query_id, query_vec)
