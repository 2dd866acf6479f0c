"""S: set operations — appending sources, keyword presence and absence."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --------------------------------------------------------------------------- S1
def union_sources(dfs: Iterable[DataFrame]) -> DataFrame:
    """Append the results of several searches/agents by column name (missing columns → NULL)."""
    dfs = list(dfs)
    if not dfs:
        raise ValueError("union_sources needs at least one DataFrame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# --------------------------------------------------------------------------- S2
def keyword_sets(cv_kw: Column, job_kw: Column) -> tuple[Column, Column]:
    """Per pair (array form): present = job ∩ cv, missing = job − cv, both sorted for stable output."""
    present = F.array_sort(F.array_intersect(job_kw, cv_kw))
    missing = F.array_sort(F.array_except(job_kw, cv_kw))
    return present, missing


def keyword_sets_rows(cv_words: DataFrame, job_words: DataFrame, col: str = "keyword") -> DataFrame:
    """Per corpus (row form): every distinct job keyword with ``present`` true/false.

    One pass: both corpora are flagged, appended and reduced to one row per keyword (map-side first).
    """
    j, c = F.lit(True), F.lit(False)
    both = job_words.select(F.col(col), j.alias("_job"), c.alias("_cv")).unionByName(
        cv_words.select(F.col(col), c.alias("_job"), j.alias("_cv")))
    found = both.groupBy(col).agg(F.bool_or("_job").alias("_job"), F.bool_or("_cv").alias("present"))
    return found.where("_job").select(col, "present")
