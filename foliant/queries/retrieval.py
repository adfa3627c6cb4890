"""Queries over the lexical and dense indexes.

Evaluation items are the query texts, chunks the collection; vec_id of ``embeddings`` is read as a chunk's seq, and item i has vector i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import BLANK
from foliant.operators import dense, fusion
from foliant.operators.lexical import LexicalIndex, top_k
from foliant.sources.tables import table


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks")


def _index(spark: SparkSession, folder: str) -> LexicalIndex:
    return LexicalIndex(_chunks(spark, folder), "seq", "text")


def bm25_term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).search(table(spark, folder, "eval_items"), "item_id", "text").withColumnRenamed("item", "seq")


def bm25_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The filter comes after the global cut, so fewer than k or no hits may be left; they are ranked anew."""
    hits = _index(spark, folder).search(table(spark, folder, "eval_items"), "item_id", "text")
    owner = _chunks(spark, folder).select(F.col("seq").alias("item"), "chunk_type").distinct().filter("chunk_type = 'structural'")
    return top_k(hits.drop("rank").join(owner, "item").select("query_id", "item", "score"), 8).withColumnRenamed("item", "seq")


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").filter("vec_id % 100 = 0")


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    return dense.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", _queries(spark, folder), "vec_id", "embedding").withColumnRenamed("item", "vec_id")


def dense_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The filter comes before the ranking."""
    rows = table(spark, folder, "embeddings").filter("label = 1")
    return dense.nearest(rows, "vec_id", "embedding", _queries(spark, folder), "vec_id", "embedding").withColumnRenamed("item", "vec_id")


def dense_ann_topk(spark: SparkSession, folder: str) -> DataFrame:
    index = dense.InvertedFile(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return index.search(_queries(spark, folder), "vec_id", "embedding").withColumnRenamed("item", "vec_id")


def _hybrid(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items")
    vectors = table(spark, folder, "embeddings")
    known = _chunks(spark, folder).select(F.col("seq").alias("vec_id")).distinct()
    near = dense.nearest(vectors.join(known, "vec_id", "left_semi"), "vec_id", "embedding", vectors.join(items.select(F.col("item_id").alias("vec_id")).distinct(), "vec_id", "left_semi"), "vec_id", "embedding")
    return fusion.reciprocal_rank_fusion(near, _index(spark, folder).search(items, "item_id", "text")).withColumnRenamed("item", "seq")


def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return _hybrid(spark, folder)


def hybrid_rrf_top6(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.final(_hybrid(spark, folder), None)


def tool_result_projection(spark: SparkSession, folder: str) -> DataFrame:
    """What a caller sees of the final hits: text and provenance, no scores."""
    hits = fusion.final(_hybrid(spark, folder), None).select("query_id", "seq", "rank")
    chunks = _chunks(spark, folder).select("seq", "chunk_id", "text", "doc_id", "page_start", "page_end", "section_path").distinct()
    return hits.join(chunks, "seq").select("query_id", "rank", "chunk_id", F.coalesce("text", F.lit("")).alias("text"), "doc_id", "page_start", "page_end", F.col("section_path").alias("section"))


QUERIES = [bm25_term_stats, bm25_topk, bm25_topk_filtered, dense_topk, dense_topk_filtered, dense_ann_topk, hybrid_rrf, hybrid_rrf_top6, tool_result_projection]

_BM25 = rf"""
    c AS (SELECT DISTINCT seq, coalesce(text, '') AS text FROM chunks),
    w AS (SELECT seq, list_filter(regexp_split_to_array(lower(text), '{BLANK}+'), lambda x: x <> '') AS w FROM c),
    n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
    p AS (SELECT term, seq, dl, count(*) AS tf FROM (SELECT seq, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY ALL),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, n),
    t AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
    q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '{BLANK}+'), lambda x: x <> '')) AS term FROM eval_items) GROUP BY ALL),
    s AS (SELECT query_id, seq, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN t USING (term) JOIN p USING (term), n GROUP BY ALL HAVING score > 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM s QUALIFY rank <= 8)"""


def _dense_sql(rows: str, queries: str, name: str) -> str:
    return f"""{name} AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
        FROM (SELECT * FROM embeddings WHERE {queries}) q, (SELECT * FROM embeddings WHERE {rows}) e) QUALIFY rank <= 8)"""


_HYBRID = f"""WITH {_BM25}, {_dense_sql('vec_id IN (SELECT seq FROM chunks)', 'vec_id IN (SELECT item_id FROM eval_items)', 'v')},
    f AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(vec_id, seq) AS seq, coalesce(v.score, b.score) AS score, v.rank AS dr, b.rank AS br,
          round(coalesce(0.5 / (60 + v.rank), 0) + coalesce(0.5 / (60 + b.rank), 0), 9) AS fused_score
          FROM v FULL JOIN b ON v.query_id = b.query_id AND v.vec_id = b.seq),
    h AS (SELECT query_id, seq, score, fused_score, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, dr NULLS LAST, br NULLS LAST) AS rank FROM f)"""

SQL = {
    "bm25_term_stats": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM t",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, seq, score, rank FROM b",
    "bm25_topk_filtered": f"WITH {_BM25} SELECT query_id, seq, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM b WHERE seq IN (SELECT seq FROM chunks WHERE chunk_type = 'structural')",
    "dense_topk": f"WITH {_dense_sql('true', 'vec_id % 100 = 0', 'v')} SELECT query_id, vec_id, score, rank FROM v",
    "dense_topk_filtered": f"WITH {_dense_sql('label = 1', 'vec_id % 100 = 0', 'v')} SELECT query_id, vec_id, score, rank FROM v",
    "hybrid_rrf": f"{_HYBRID} SELECT query_id, seq, score, fused_score, rank FROM h",
    "hybrid_rrf_top6": f"{_HYBRID} SELECT query_id, seq, score, fused_score, rank FROM h WHERE rank <= 6",
    "tool_result_projection": f"""{_HYBRID} SELECT query_id, rank, chunk_id, coalesce(text, '') AS text, doc_id, page_start, page_end, section_path AS section
        FROM h JOIN (SELECT DISTINCT seq, chunk_id, text, doc_id, page_start, page_end, section_path FROM chunks) USING (seq) WHERE rank <= 6""",
}
