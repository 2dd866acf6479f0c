"""A8/A9: chart documents and table inventory."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Allowed chart types and the colour palette (assigned by rank, cycling).
CHART_TYPES = ["pie", "bar", "donut", "horizontalBar", "funnel", "line"]
PALETTE = ["#3B82F6", "#10B981", "#F59E0B", "#EF4444", "#6366F1", "#8B5CF6", "#A855F7", "#6B7280"]


def chart_json(points: DataFrame, charts: DataFrame) -> DataFrame:
    """Chart documents ``{key,title,type,description,data:[{name,value,color}]}`` as JSON text.

    ``points``: key, name, value, rank (1 = first point);  ``charts``: key, title, type, description.
    Points are few per chart (top-k reports), so one ``collect_list`` per chart is bounded.
    Charts of a type outside the six allowed ones are dropped.
    """
    palette = F.array(*[F.lit(c) for c in PALETTE])
    pts = points.select("key", "rank", F.struct(
        F.col("name").cast("string").alias("name"), F.col("value").alias("value"),
        F.element_at(palette, ((F.col("rank") - 1) % len(PALETTE) + 1).cast("int")).alias("color")).alias("p"))
    data = pts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "p"))).alias("_d")).select(
        "key", F.transform("_d", lambda x: x["p"]).alias("data"))
    ch = charts.where(F.col("type").isin(CHART_TYPES))
    doc = ch.join(data, "key", "left").select(
        "key", F.to_json(F.struct("key", "title", "type", "description",
                                  F.coalesce("data", F.array().cast(data.schema["data"].dataType)).alias("data"))).alias("chart"))
    return doc


def ranked_points(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Attach ranks (value desc, name asc) to chart points of one chart."""
    w = Window.orderBy(F.col(value).desc(), F.col(name).asc())
    return df.select(F.lit(key).alias("key"), F.col(name).alias("name"), F.col(value).alias("value"),
                     F.row_number().over(w).alias("rank"))


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table (one aggregate each, unioned), ordered by name."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
             for name, df in sorted(tables.items())]
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy("table_name")


def text_profile(df: DataFrame, text: str, parsed: str | None = None) -> DataFrame:
    """A9 companion: rows, how many are parsed, and the text-length profile (one aggregate)."""
    n = F.length(F.col(text))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count_if(F.col(parsed).isNotNull()) if parsed else F.lit(None).cast("bigint")).alias("parsed"),
        F.min(n).alias("min_len"), F.round(F.avg(n), 2).alias("avg_len"), F.max(n).alias("max_len"),
    )
