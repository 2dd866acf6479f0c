"""Small shared helpers for the operators."""

from __future__ import annotations

from pyspark.sql import functions as F


def words(col, pattern: str = r"[^\p{L}\p{N}]+"):
    """Lower-cased word tokens of a string column (empty tokens removed)."""
    return F.filter(F.split(F.lower(col), pattern), lambda w: w != F.lit(""))
