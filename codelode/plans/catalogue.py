"""All queries of the core library and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codelode.plans import corpus, graphs, hierarchy, rankings, structure

_PARTS = (corpus, graphs, hierarchy, rankings, structure)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for part in _PARTS for k, q in part.ORACLE.items()}
