"""From registered files to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import strip
from foliant.operators import chunking
from foliant.plans.lineage import cut
from foliant.plans.ordered import carried
from foliant.plans.skew import union_all
from foliant.sources import layout, registry


def chunks_of(items: DataFrame, skip_images: bool = False) -> DataFrame:
    """(seq, chunk_id, doc_id, chunk_type, text, page_start, page_end, section_path, meta) of layout items.

    Prose between headers, tables and pictures in windows, each table as it stands, and each picture that has a description unless
    ``skip_images``. Sections are the last header above. Null texts are empty; documents without items have no chunks.
    """
    none = F.create_map().cast("map<string,string>")
    prose = chunking.section_chunks(items).select("doc_id", F.lit("structural").alias("chunk_type"), "text", "page_start", "page_end", "section_path")
    i = items.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "kind", F.coalesce("page_no", F.lit(0)).alias("page_no"), F.coalesce("text", F.lit("")).alias("text"))
    placed = carried(i, "doc_id", "seq", {}, {"section_path": F.when(F.col("kind") == "header", strip("text"))}, {})
    whole = placed.filter("kind = 'table'" if skip_images else "kind IN ('table', 'picture')").filter("text <> ''")
    kind = F.when(F.col("kind") == "table", "atomic_table").otherwise("image_analysis")
    rest = whole.select("doc_id", kind.alias("chunk_type"), "text", F.col("page_no").alias("page_start"), F.col("page_no").alias("page_end"), F.coalesce("section_path", F.lit("")).alias("section_path"))
    rows = cut(union_all([prose, rest]).withColumn("meta", none).withColumn("seq", F.monotonically_increasing_id()))
    return rows.join(chunking.unique_ids(rows).select("seq", "chunk_id"), "seq").select("seq", "chunk_id", *[c for c in rows.columns if c != "seq"])


def build(spark: SparkSession, registered: DataFrame, root: str, parsers: dict[str, layout.Parser] | None = None, skip_images: bool = False) -> DataFrame:
    """The chunks of the registered documents whose files exist under ``root``."""
    return chunks_of(cut(layout.parsed(registry.existing(spark, registered, root), parsers)), skip_images)
