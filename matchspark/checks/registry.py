"""Registered queries, their oracle SQL and the inventory items they cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchspark.checks.oracle_views import ORACLE_VIEWS
from matchspark.fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def check(name: str, covers: str, oracle: str | None = None):
    """Register ``fn(tables)`` as a query. ``oracle`` may use the fixture views by name."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.area = fn.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = run
        COVERS[name] = covers.split()
        if oracle is not None:
            ORACLES[name] = with_views(oracle, more_views=ORACLE_VIEWS)
        return fn

    return register
