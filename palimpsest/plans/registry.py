"""Registered queries over the given tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans.fixtures import BASE_SQL, Evidence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True) -> Callable:
    """Registers a function of Evidence; sql follows the common table expressions of BASE_SQL unless base is false."""

    def add(f: Callable[[Evidence], DataFrame]) -> Callable[[Evidence], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Evidence(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            ORACLE_SQL[name] = (BASE_SQL.rstrip() + ",\n" + text[5:] if text.upper().startswith("WITH ") else BASE_SQL + text) if base else text
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Localities ranked by what the interval filter leaves."""
    return QUERIES["j12_localities"](spark, sf_dir)


from palimpsest.plans import assembly_queries, catalog_queries, discovery_queries, evidence_queries, hierarchy_queries, ingest_queries, source_queries, unify_queries  # noqa: E402, F401
