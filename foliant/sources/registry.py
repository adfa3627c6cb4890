"""The document registry: which documents there are, and which of their files exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tidy_path(c: Column) -> Column:
    """One slash between names, no ./ and blanks at the ends, slashes for backslashes, the ending in lower case; null if nothing is left."""
    p = F.trim(F.regexp_replace(F.regexp_replace(F.translate(c, "\\", "/"), "/+", "/"), r"(^|/)(\./)+", "$1"))
    return F.nullif(F.concat(F.regexp_replace(p, r"\.[^./]*$", ""), F.lower(F.regexp_extract(p, r"(\.[^./]*)$", 1))), F.lit(""))


def registered(registry: DataFrame) -> DataFrame:
    """(doc_id, path): each registered document once, with the tidy path of its latest registration; documents without a path are left out."""
    r = registry.select("doc_id", tidy_path(F.col("path")).alias("path"), "registered_at").dropna(subset=["doc_id", "path"])
    return r.groupBy("doc_id").agg(F.max_by("path", F.struct("registered_at", "path")).alias("path"))


def existing(spark: SparkSession, registry: DataFrame, root: str) -> DataFrame:
    """(doc_id, path, content) of the registered documents whose file exists under ``root``; others are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_replace(F.col("path"), "^.*?" + root.strip("/").replace(".", r"\.") + "/", "")
    found = files.select(tidy_path(name).alias("path"), "content")
    return registered(registry).join(found, "path").select("doc_id", "path", "content")
