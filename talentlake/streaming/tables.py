"""Tables that micro-batches keep: a base and the rows of the batches after it, merged when they are read.

A batch writes only its own rows, so its cost follows the batch and not the table; a replayed batch
overwrites its own folder.  Rows combine associatively (sums, minima, latest by order), so it does not
matter into which batches they fell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from talentlake.session import path_exists


def folders(spark: SparkSession, path: str, name: str) -> dict[int, object]:
    """Number -> path of the folders ``name=<number>`` under ``path``."""
    if not path_exists(spark, path):
        return {}
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    paths = [f.getPath() for f in found if f.isDirectory()]
    return {int(p.getName().split("=")[1]): p for p in paths if p.getName().startswith(f"{name}=")}


def finished(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """The folders that Spark has committed."""
    return {v: p.toString() for v, p in folders(spark, path, name).items() if path_exists(spark, f"{p.toString()}/_SUCCESS")}


def bases(spark: SparkSession, path: str) -> list[int]:
    return list(finished(spark, f"{path}/base", "v"))


def delete_before(spark: SparkSession, path: str, name: str, number: int) -> None:
    for v, p in folders(spark, path, name).items():
        if v < number:
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class BatchLog:
    """Rows by batch under ``path``; ``merge`` combines any rows of the table into one row per key.

    Every ``compact_every`` batches the merged table becomes a base; what the base before it had replaced is
    deleted, so a reader (or a replay of the last batch) that starts from that one still finds its files.
    With ``key`` a base lies in ``buckets`` folders by the key's hash, and a batch that looks up its own keys
    (``only``) reads the folders they are in.  ``keep`` drops rows from new bases (retention).
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, merge: Callable[[DataFrame], DataFrame],
                 key: str | None = None, buckets: int = 1, compact_every: int = 16,
                 keep: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.schema, self.merge = spark, path, schema, merge
        self.key, self.buckets, self.compact_every, self.keep = key, buckets if key else 1, compact_every, keep

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/log/_batch={batch_id}")

    def compact(self, batch_id: int) -> None:
        """New base out of everything up to ``batch_id``, when that batch is due; a replay finds it done."""
        older = [v for v in bases(self.spark, self.path) if v <= batch_id]
        if (batch_id + 1) % self.compact_every or batch_id in older:
            return
        table = self.table(before=batch_id + 1)
        table = self.keep(table) if self.keep else table
        out = f"{self.path}/base/v={batch_id}"
        if self.buckets > 1:
            table.withColumn("_bucket", self._bucket()).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(out)
        else:
            table.write.mode("overwrite").parquet(out)
        if older:
            delete_before(self.spark, f"{self.path}/log", "_batch", max(older) + 1)
            delete_before(self.spark, f"{self.path}/base", "v", max(older))

    def rows(self, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """Unmerged rows of the batches before ``before`` (all); with ``only``, of its keys."""
        spark = self.spark
        known = [v for v in bases(spark, self.path) if before is None or v < before]
        base = max(known, default=-1)
        parts = []
        if known:
            at = f"{self.path}/base/v={base}"
            bucket = [StructField("_bucket", IntegerType())] if self.buckets > 1 else []
            got = spark.read.schema(StructType([*self.schema.fields, *bucket])).parquet(at)
            if bucket and only is not None:
                hit = [r[0] for r in only.select(self._bucket()).distinct().collect()]  # at most ``buckets`` numbers
                got = got.where(F.col("_bucket").isin(hit))
            parts.append(got.select(*self.schema.names))
        later = [p for v, p in finished(spark, f"{self.path}/log", "_batch").items() if v > base and (before is None or v < before)]
        if later:
            parts.append(spark.read.schema(self.schema).parquet(*later))
        if not parts:
            return spark.createDataFrame([], self.schema)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out if only is None else out.join(only.select(self.key), self.key, "left_semi")

    def table(self, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        return self.merge(self.rows(before, only))
