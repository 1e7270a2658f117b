"""Registry of named queries.

Each entry pairs a Spark builder ``(spark, sf_dir) -> DataFrame`` with the
equivalent DuckDB SQL over the raw tables (fixture views inlined as CTEs), or
``None`` where the operator is not expressible in SQL (golden tests cover it).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from almanac.sources import fixtures as FX


@dataclass
class Query:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    family: str


REGISTRY: dict[str, Query] = {}


def register(key: str, oracle: str | None, family: str):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, fn, oracle, family)
        return fn
    return deco


def with_views(*names: str) -> str:
    """``WITH`` clause inlining the fixture views for the DuckDB oracle."""
    return "with " + ",\n".join(f"{n} as ({FX.fixture_sql(n, 'duckdb')})" for n in names) + "\n"


def all_queries() -> dict[str, Query]:
    # Import the query modules for their registration side effect.
    from almanac.plans import q_telemetry, q_transactions, q_media, q_cross, q_ingest, q_misc  # noqa: F401
    return REGISTRY
