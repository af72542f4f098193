"""Named queries and, where SQL can say the same, their comparison text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quotemill.plans.market import Market, with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Market], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Market(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Registers ``build(market)`` under a name; ``views`` are what the SQL text reads."""

    def register(build: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = Query(name, build, with_views(sql, *views) if sql else None)
        return build

    return register


def load_all() -> dict[str, Query]:
    from quotemill.plans import (  # noqa: F401
        account_queries,
        coverage_queries,
        fundamental_queries,
        load_queries,
        price_queries,
        quality_queries,
        scan_queries,
        source_queries,
        stream_queries,
    )

    return QUERIES
