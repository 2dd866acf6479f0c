"""A1: typed table scans.

Every scan goes through ``spark.read.parquet`` so that Catalyst can prune
columns and push filters into the Parquet reader; nothing is read eagerly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def scan(spark: SparkSession, sf_dir: str, name: str, schema: StructType | None = None) -> DataFrame:
    """Read one table; with ``schema`` the file footer is not inferred (production path)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders`` is a scan of orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = scan(self.spark, self.sf_dir, name)
        return self._cache[name]


def list_newest(df: DataFrame, ts: str, key: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Unpaged list newest first (default page ``limit 100 offset 0``), id as tiebreak."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must be >= 0")
    return df.orderBy(F.col(ts).desc_nulls_first(), F.col(key).asc()).offset(offset).limit(limit)
