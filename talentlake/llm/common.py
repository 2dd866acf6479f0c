"""Shared helpers: scratch tables in the cluster's shared folder and row keys."""

from __future__ import annotations

import contextlib
import contextvars
import gc
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from talentlake.session import scratch_path, ship_package

#: the characters that separate words and that normalisation deletes: space and \t \n \v \f \r
WHITESPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


_owner: contextvars.ContextVar[list[Scratch] | None] = contextvars.ContextVar("owner", default=None)


@contextlib.contextmanager
def owned() -> Iterator[list[Scratch]]:
    """The folders that operators called inside make, for a caller that knows when their results are no longer read."""
    folders: list[Scratch] = []
    token = _owner.set(folders)
    try:
        yield folders
    finally:
        _owner.reset(token)


class Scratch:
    """Tables of one operator call under ``spark.checkpoint.dir`` (shared by all machines).

    A written table cuts the lineage: a lost executor makes later stages read files again instead
    of recomputing upstream work.  ``drop`` deletes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.root = scratch_path(spark, name)
        self.names: list[str] = []
        if (folders := _owner.get()) is not None:
            folders.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.names.append(name)
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps (it does when the driver collects garbage).

        The last step's plan, and so its files, stay in the hands of Spark's event queues until another step comes."""
        self.spark.range(1).collect()
        gc.collect()
        self.spark._jvm.System.gc()

    def keep_only(self, *names: str) -> None:
        """Delete all other tables: the result reads these."""
        for name in [n for n in self.names if n not in names]:
            self.drop(name)
            self.names.remove(name)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

