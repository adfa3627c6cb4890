"""Picture queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import BLANK, json_object
from foliant.operators import images as I  # noqa: E741
from foliant.sources.tables import table

_COLUMNS = ["image_id", "doc_id", "page_no", "ordinal", "image_sha256", "perceptual_hash", "image_path", "width", "height", "should_index", "image_type", "title", "summary", "extracted_text", "entities", "relationships", "search_terms", "confidence", "from_cache"]


def _images(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "images").select(*_COLUMNS).distinct()


def _lists(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(c, "|") for c in ("entities", "relationships", "search_terms")})


def analysis_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _lists(I.normalized(_images(spark, folder)))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return I.results(I.normalized(_images(spark, folder)))


def analysis_result(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).select("image_id", "should_index", "image_type", "title", "confidence")


def analysis_chunk_text(spark: SparkSession, folder: str) -> DataFrame:
    return _results(spark, folder).select("image_id", I.chunk_text().alias("text"))


def analysis_meta(spark: SparkSession, folder: str) -> DataFrame:
    m = _images(spark, folder).select("image_id", I.structured_meta().alias("m"))
    return m.select("image_id", F.size("m").alias("entries"), *[F.col("m")[k].alias(k) for k in ("image_sha256", "image_phash", "image_type", "image_width", "image_ordinal", "image_search_terms")])


def image_prepared(spark: SparkSession, folder: str) -> DataFrame:
    return _images(spark, folder).filter(I.large_enough()).select("image_id", "width", "height")


def image_indexable(spark: SparkSession, folder: str) -> DataFrame:
    return I.indexable(_images(spark, folder)).select("image_id", "doc_id", "ordinal")


def image_cache_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Analysed pictures fill the cache; all are looked up in it."""
    rows = _images(spark, folder)
    return I.cache_probe(rows, rows.filter("NOT from_cache"))


def image_dhash(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors read as grids of 8 columns."""
    return table(spark, folder, "embeddings").select("vec_id", I.difference_hash(F.col("embedding"), 8).alias("hash"))


def json_objects(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", json_object("props").alias("object"))
    return rows.select("event_id", F.get_json_object("object", "$.k").cast("int").alias("k"))


QUERIES = [analysis_normalize, analysis_result, analysis_chunk_text, analysis_meta, image_prepared, image_indexable, image_cache_probe, image_dhash, json_objects]


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _list(c: str) -> str:
    return f"coalesce(list_filter(list_transform({c}, lambda x: {_strip('x')}), lambda x: x <> ''), [])"


_T = "lower(" + _strip("coalesce(nullif(image_type, ''), 'other')") + ")"
_I = f"""
    i AS (SELECT DISTINCT * EXCLUDE (analyzed_at, section_path) FROM images),
    a AS (SELECT image_id, CASE WHEN {_T} IN ('logo', 'decorative', 'photo') THEN false WHEN {_T} IN ({', '.join(f"'{t}'" for t in I.TECHNICAL)}) THEN coalesce(should_index, false) OR {_T} <> 'other' ELSE coalesce(should_index, false) END AS should_index, {_T} AS image_type,
        {', '.join(f"{_strip(f"coalesce({c}, '')")} AS {c}" for c in ('title', 'summary', 'extracted_text'))}, {', '.join(f"{_list(c)} AS {c}" for c in ('entities', 'relationships', 'search_terms'))}, coalesce(confidence, 0.0) AS confidence FROM i),
    r AS (SELECT * REPLACE (CASE WHEN image_type IN ({', '.join(f"'{t}'" for t in I.TECHNICAL + I.DECORATION)}) THEN image_type ELSE 'other' END AS image_type, CASE WHEN image_type IN ('logo', 'decorative') THEN false ELSE should_index END AS should_index, coalesce(nullif(title, ''), 'Document image') AS title) FROM a)"""

SQL = {k: f"WITH {_I} {v}" for k, v in {
    "analysis_normalize": "SELECT * REPLACE (array_to_string(entities, '|') AS entities, array_to_string(relationships, '|') AS relationships, array_to_string(search_terms, '|') AS search_terms) FROM a",
    "analysis_result": "SELECT image_id, should_index, image_type, title, confidence FROM r",
    "analysis_chunk_text": """SELECT image_id, concat_ws(chr(10), 'Image type: ' || image_type, 'Title: ' || title, 'Summary: ' || summary, CASE WHEN extracted_text <> '' THEN 'Visible text: ' || extracted_text END, CASE WHEN len(entities) > 0 THEN 'Entities: ' || array_to_string(entities, ', ') END,
        CASE WHEN len(relationships) > 0 THEN 'Relationships: ' || array_to_string(relationships, '; ') END, CASE WHEN len(search_terms) > 0 THEN 'Search terms: ' || array_to_string(search_terms, ', ') END) AS text FROM r""",
    "analysis_meta": "SELECT image_id, 12 AS entries, coalesce(image_sha256, '') AS image_sha256, coalesce(perceptual_hash, '') AS image_phash, coalesce(image_type, '') AS image_type, coalesce(CAST(width AS VARCHAR), '') AS image_width, coalesce(CAST(ordinal AS VARCHAR), '') AS image_ordinal, coalesce(array_to_string(search_terms, ','), '') AS image_search_terms FROM i",
    "image_prepared": "SELECT image_id, width, height FROM i WHERE width >= 32 AND height >= 32",
    "image_indexable": "SELECT image_id, doc_id, ordinal FROM i WHERE should_index QUALIFY row_number() OVER (PARTITION BY doc_id, coalesce(image_sha256, '#' || image_id) ORDER BY ordinal NULLS FIRST, image_id) = 1",
    "image_cache_probe": """,
        l AS (SELECT DISTINCT image_id, lower(image_sha256) AS sha, lower(perceptual_hash) AS ph, CASE WHEN regexp_full_match(perceptual_hash, '[0-9a-fA-F]{16}') THEN CAST('0x' || perceptual_hash AS UBIGINT) END AS h, from_cache FROM i),
        c AS (SELECT sha, ph, h FROM l WHERE NOT from_cache AND sha IS NOT NULL),
        n AS (SELECT l.image_id, (min((c.ph, c.sha)))[2] AS s FROM l JOIN c ON bit_count(xor(l.h, c.h)) <= 3 GROUP BY l.image_id)
        SELECT DISTINCT l.image_id, CASE WHEN l.sha IN (SELECT sha FROM c) THEN 'exact' WHEN n.s IS NOT NULL THEN 'near' ELSE 'none' END AS hit, CASE WHEN l.sha IN (SELECT sha FROM c) THEN l.sha ELSE n.s END AS cache_sha FROM l LEFT JOIN n USING (image_id)""",
}.items()} | {
    "image_dhash": """WITH b AS (SELECT vec_id, list_transform(list_filter(range(0, len(embedding) - 1), lambda i: i % 8 <> 7), lambda i: CASE WHEN embedding[i + 1] > embedding[i + 2] THEN 1 ELSE 0 END) AS b FROM embeddings)
        SELECT vec_id, array_to_string(list_transform(range(0, len(b) // 4), lambda k: substr('0123456789abcdef', CAST(b[4 * k + 1] * 8 + b[4 * k + 2] * 4 + b[4 * k + 3] * 2 + b[4 * k + 4] + 1 AS BIGINT), 1)), '') AS hash FROM b""",
    "json_objects": "SELECT event_id, CAST(props ->> '$.k' AS INT) AS k FROM events",
}
