"""The engine's queries by name, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.queries import audit, chunking, graph, images, quantities, registry, retrieval


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in (quantities, retrieval, chunking, audit, images):
        out |= {f.__name__: f for f in module.QUERIES}
    return out | graph.QUERIES | registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return quantities.SQL | retrieval.SQL | chunking.SQL | graph.SQL | audit.SQL | images.SQL | registry.SQL
