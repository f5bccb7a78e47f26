"""Collects the registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placestat.sources.fixtures import Tables, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: str = "", more: str = ""):
    """Register f(tables) under ``name``; the SQL gets the projections in ``needs`` and CTEs ``more`` first."""

    def register(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            head = ", ".join(x for x in (ctes(needs) if needs else "", more) if x)
            ORACLE_SQL[name] = (f"WITH {head} " if head else "") + sql
        return f

    return register
