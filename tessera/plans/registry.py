"""Names of queries, what runs them, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.project import Model, oracle_text

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, model) under a name, with its oracle."""

    def add(run: Callable[[SparkSession, Model], DataFrame]) -> Callable:
        _QUERIES[name] = (lambda spark, sf_dir: run(spark, Model(spark, sf_dir)), sql and oracle_text(sql))
        return run

    return add


def _load() -> None:
    from tessera.plans import graph_queries, memory_queries, more_queries, record_queries, space_queries, write_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracles() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hops from the best connected customer, as of a revision."""
    return queries()["two_hops_at_revision"](spark, sf_dir)
