"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB oracle per operator.

Every query reads the given tables (or views Spark derives from them) whole;
nothing is filtered to an id subset or capped, except where a limit *is* the
feature (top-k reports, paging).

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> SQL``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import every query module so that its ``register`` calls run."""
    from talentlake.plans import (  # noqa: F401
        q_aggs,
        q_filters,
        q_ingest,
        q_joins,
        q_ranking,
        q_streams,
        q_text,
        q_vectors,
        q_work,
    )
