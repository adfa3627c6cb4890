"""The registry query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.sources.registry import registered
from foliant.sources.tables import table


def registry_scan(spark: SparkSession, folder: str) -> DataFrame:
    return registered(table(spark, folder, "registry"))


QUERIES = {"registry_scan": registry_scan}

_TIDY = r"trim(regexp_replace(regexp_replace(replace(path, '\', '/'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'))"

SQL = {
    "registry_scan": rf"""WITH t AS (SELECT doc_id, registered_at, {_TIDY} AS p FROM registry),
        u AS (SELECT doc_id, registered_at, nullif(regexp_replace(p, '\.[^./]*$', '') || lower(regexp_extract(p, '(\.[^./]*)$', 1)), '') AS path FROM t WHERE doc_id IS NOT NULL)
        SELECT doc_id, (max((registered_at, path)))[2] AS path FROM u WHERE path IS NOT NULL GROUP BY doc_id""",
}
