"""Chunking queries. Lines of ``documents`` stand for layout items, with five lines a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import BLANK
from foliant.operators import chunking as C
from foliant.sources.layout import text_items
from foliant.sources.tables import table


def chunk_prose_windows(spark: SparkSession, folder: str) -> DataFrame:
    return C.prose_windows(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("item", "doc_id")


def chunk_sections(spark: SparkSession, folder: str) -> DataFrame:
    return C.section_chunks(text_items(table(spark, folder, "documents"), "doc_id", "text"))


def atomic_table_chunks(spark: SparkSession, folder: str) -> DataFrame:
    cells = [("Register", "register_name"), ("Bits", "bit_range"), ("Field", "name"), ("Type", "access"), ("Reset", "reset_value")]
    return C.register_chunks(table(spark, folder, "bit_fields"), "doc_id", "register_name", "field_id", cells)


def bitfield_table_detect(spark: SparkSession, folder: str) -> DataFrame:
    """The header is what stands before the colons in the first line that has bars."""
    rows = table(spark, folder, "chunks").filter("chunk_type = 'atomic_table' AND text IS NOT NULL").select("seq", F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|"))).alias("l")).distinct()
    header = F.transform(F.split(F.get("l", F.lit(0)), r"\|"), lambda x: F.trim(F.substring_index(x, ":", 1)))
    return rows.filter("size(l) > 0").select("seq", C.header_hits(header).alias("hits"), C.looks_like_bit_fields(header).alias("bit_fields"))


def chunk_ids_unique(spark: SparkSession, folder: str) -> DataFrame:
    return C.unique_ids(table(spark, folder, "chunks"))


def chunk_ids_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Ids made of document and type alone collide; all but the first are repaired."""
    rows = table(spark, folder, "chunks").withColumn("raw", F.concat_ws("_", F.coalesce("doc_id", F.lit("")), C.short_hash(F.coalesce("chunk_type", F.lit("")))))
    return C.repaired_ids(rows, "raw")


def chunk_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of prose as the store, the rest and later deliveries as the update."""
    rows = table(spark, folder, "chunks").select("chunk_id", "seq", "doc_id", "chunk_type", "page_start", "ingested_at")
    prose = F.coalesce(F.col("chunk_type") == "structural", F.lit(False))
    return C.upserted(rows.filter(prose), rows.filter(~prose).unionByName(rows), "chunk_id", "ingested_at")


def chunk_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("seq", C.canonical_map(C.metadata()).alias("metadata")).distinct()


def whole_table_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each register's fields as a table with or without a register column, by its width."""
    reg = table(spark, folder, "registers").select("reg_id", "doc_id", "name", "width_bits", "fields").distinct()
    own = F.coalesce(F.col("width_bits") == 32, F.lit(False))
    rows = F.transform(F.coalesce("fields", F.array().cast(reg.schema["fields"].dataType)), lambda f: F.when(own, F.array(F.col("name"), f["name"], f["bit_range"], f["access"])).otherwise(F.array(f["name"], f["bit_range"], f["access"])))
    header = F.when(own, F.array(*map(F.lit, ("Register", "Field", "Bits", "Access")))).otherwise(F.array(*map(F.lit, ("Field", "Bits", "Access"))))
    items = reg.select("doc_id", F.col("reg_id").alias("seq"), F.lit("table").alias("kind"), F.lit(1).alias("page_no"), F.struct(header.alias("header"), rows.alias("rows")).alias("table"))
    return C.table_chunks(items).select("seq", "register", "text")


QUERIES = [chunk_metadata, whole_table_chunks, chunk_prose_windows, chunk_sections, atomic_table_chunks, bitfield_table_detect, chunk_ids_unique, chunk_ids_repaired, chunk_upsert]

_WORDS = f"list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda x: x <> '')"
_WINDOWS = "CASE WHEN len(w) <= 400 THEN [text] ELSE list_transform(range(0, CAST(ceil((len(w) - 400) / 350.0) AS BIGINT) + 1), lambda i: array_to_string(list_slice(w, i * 350 + 1, i * 350 + 400), ' ')) END"
_ITEMS = rf"""
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS seq FROM (SELECT DISTINCT doc_id, text FROM documents)),
    i AS (SELECT doc_id, seq, text, (seq - 1) // 5 + 1 AS page_no, CASE WHEN regexp_full_match(text, '\s*[A-Z][A-Z0-9]*-\d+\s*') THEN 'header' WHEN regexp_matches(text, '^[A-Z0-9_]+ = 0x') THEN 'table' WHEN trim(text) <> '' THEN 'text' END AS kind FROM l)"""

SQL = {
    "chunk_metadata": """WITH c AS (SELECT DISTINCT seq, doc_id, chunk_type, page_start, page_end, section_path, meta FROM chunks)
        SELECT DISTINCT seq, array_to_string(list_sort(['doc_id=' || coalesce(doc_id, ''), 'chunk_type=' || coalesce(chunk_type, ''), 'page_start=' || coalesce(CAST(page_start AS VARCHAR), ''), 'page_end=' || coalesce(CAST(page_end AS VARCHAR), ''), 'section_path=' || coalesce(section_path, '')]
            || coalesce(list_transform(map_entries(meta), lambda e: 'meta_' || e.key || '=' || coalesce(e.value, '')), [])), ';') AS metadata FROM c""",
    "whole_table_chunks": """WITH r AS (SELECT DISTINCT reg_id, doc_id, name, width_bits, fields FROM registers),
        f AS (SELECT reg_id, name, width_bits, unnest(range(1, len(fields) + 1)) AS no, unnest(fields) AS z FROM r),
        l AS (SELECT reg_id, string_agg(CASE WHEN width_bits = 32 THEN 'Register: ' || name || ' | Field: ' || coalesce(z.name, '') || ' | Bits: ' || coalesce(z.bit_range, '') || ' | Access: ' || coalesce(z.access, '') ELSE coalesce(z.name, '') || ' | ' || coalesce(z.bit_range, '') || ' | ' || coalesce(z.access, '') END, chr(10) ORDER BY no) AS lines FROM f GROUP BY reg_id)
        SELECT reg_id AS seq, CASE WHEN width_bits = 32 THEN name END AS register, CASE WHEN width_bits = 32 THEN 'Register: ' || name || chr(10) || lines ELSE concat_ws(chr(10), 'Field | Bits | Access', lines) END AS text
        FROM r LEFT JOIN l USING (reg_id) WHERE coalesce(width_bits, 0) <> 32 OR (name IS NOT NULL AND lines IS NOT NULL)""",
    "chunk_prose_windows": f"""SELECT doc_id, window_no, text, CAST(len({_WORDS}) AS INT) AS words FROM (
        SELECT doc_id, unnest(x) AS text, CAST(unnest(range(0, len(x))) AS INT) AS window_no FROM (SELECT doc_id, {_WINDOWS} AS x FROM (SELECT doc_id, text, {_WORDS} AS w FROM documents)))""",
    "chunk_sections": f"""WITH {_ITEMS},
        r AS (SELECT *, sum(CASE WHEN kind <> 'text' THEN 1 ELSE 0 END) OVER o AS island, last_value(CASE WHEN kind = 'header' THEN trim(text) END IGNORE NULLS) OVER o AS section
              FROM i WHERE kind IS NOT NULL WINDOW o AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
        e AS (SELECT doc_id, island, min(page_no) AS page FROM r WHERE kind <> 'text' GROUP BY ALL),
        p AS (SELECT doc_id, island, string_agg(text, ' ' ORDER BY seq) AS text, arg_min(page_no, seq) AS first_page, any_value(section) AS section FROM r WHERE kind = 'text' GROUP BY ALL),
        x AS (SELECT p.doc_id, p.island, p.text, first_page AS page_start, coalesce(e.page, first_page) AS page_end, coalesce(section, '') AS section_path, {_WORDS.replace('text', 'p.text')} AS w FROM p LEFT JOIN e ON e.doc_id = p.doc_id AND e.island = p.island + 1),
        y AS (SELECT *, {_WINDOWS} AS z FROM x)
        SELECT doc_id, CAST(island AS BIGINT) AS island, CAST(unnest(range(0, len(z))) AS INT) AS window_no, unnest(z) AS text, page_start, page_end, section_path FROM y""",
    "atomic_table_chunks": """SELECT doc_id, register_name AS register, 'Register: ' || register_name || chr(10) || string_agg('Register: ' || register_name || ' | Bits: ' || coalesce(bit_range, '') || ' | Field: ' || coalesce(name, '') || ' | Type: ' || coalesce(access, '') || ' | Reset: ' || coalesce(reset_value, ''), chr(10) ORDER BY field_id) AS text, count(*) AS rows
        FROM (SELECT DISTINCT field_id, doc_id, register_name, bit_range, name, access, reset_value FROM bit_fields WHERE register_name IS NOT NULL) GROUP BY doc_id, register_name""",
    "bitfield_table_detect": f"""WITH l AS (SELECT DISTINCT seq, list_filter(string_split(text, chr(10)), lambda x: contains(x, '|'))[1] AS l FROM chunks WHERE chunk_type = 'atomic_table'),
        h AS (SELECT seq, lower(array_to_string(list_transform(string_split(l, '|'), lambda x: trim(string_split(x, ':')[1])), ' ')) AS h FROM l WHERE l IS NOT NULL)
        SELECT seq, CAST(len(list_filter({C.HEADER_WORDS}, lambda w: contains(h, w))) AS INT) AS hits, len(list_filter({C.HEADER_WORDS}, lambda w: contains(h, w))) >= 2 AS bit_fields FROM h""",
    "chunk_ids_unique": """WITH c AS (SELECT DISTINCT seq, coalesce(doc_id, '') AS doc, concat_ws(':', coalesce(doc_id, ''), coalesce(text, ''), coalesce(chunk_type, ''), coalesce(CAST(page_start AS VARCHAR), ''), coalesce(CAST(page_end AS VARCHAR), ''), coalesce(section_path, ''),
              coalesce(array_to_string(list_sort(list_transform(map_entries(meta), lambda e: e.key || '=' || coalesce(e.value, ''))), ';'), '')) AS sig FROM chunks),
        n AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY seq) - 1 AS occurrence FROM c)
        SELECT seq, occurrence, doc || '_' || substr(sha1(sig || ':' || occurrence), 1, 12) AS chunk_id FROM n""",
    "chunk_ids_repaired": """WITH c AS (SELECT DISTINCT seq, coalesce(doc_id, '') || '_' || substr(sha1(coalesce(chunk_type, '')), 1, 12) AS base, concat_ws(':', coalesce(chunk_type, ''), coalesce(CAST(page_start AS VARCHAR), ''), coalesce(CAST(page_end AS VARCHAR), ''), coalesce(section_path, '')) AS rest FROM chunks)
        SELECT seq, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY seq) = 1 THEN base ELSE base || '_' || substr(sha1(concat_ws(':', base, CAST(seq AS VARCHAR), rest)), 1, 8) END AS id FROM c""",
    "chunk_upsert": "SELECT chunk_id, arg_max(seq, ingested_at) AS seq, arg_max(doc_id, ingested_at) AS doc_id, any_value(chunk_type) AS chunk_type, any_value(page_start) AS page_start, max(ingested_at) AS ingested_at FROM chunks GROUP BY chunk_id",
}
