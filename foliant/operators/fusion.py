"""Reciprocal-rank fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The fusion's defaults.
RRF_K, DENSE_WEIGHT, LEXICAL_WEIGHT, FINAL_K = 60, 0.5, 0.5, 6


def reciprocal_rank_fusion(dense: DataFrame, lexical: DataFrame, k: int = RRF_K, dense_weight: float = DENSE_WEIGHT, lexical_weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """(query_id, item, score, fused_score, rank) of two rankings (query_id, item, score, rank from 1).

    An item scores weight / (k + rank) in each ranking that holds it; its own score is the dense one where there is one.
    Ties go by dense rank, then by lexical rank. One union and one grouping, instead of a full join.
    """
    both = dense.select("query_id", "item", "score", F.col("rank").alias("dense_rank"), F.lit(None).cast("bigint").alias("lexical_rank")).unionByName(
        lexical.select("query_id", "item", "score", F.lit(None).cast("bigint").alias("dense_rank"), F.col("rank").alias("lexical_rank"))
    )
    one = F.when(F.col("dense_rank").isNotNull(), dense_weight / (k + F.col("dense_rank"))).otherwise(lexical_weight / (k + F.col("lexical_rank")))
    fused = both.groupBy("query_id", "item").agg(
        F.round(F.sum(one), 9).alias("fused_score"), F.min("dense_rank").alias("dense_rank"), F.min("lexical_rank").alias("lexical_rank"), F.max(F.when(F.col("dense_rank").isNotNull(), F.col("score"))).alias("dense_score"), F.max("score").alias("any_score")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"))
    return fused.select("query_id", "item", F.coalesce("dense_score", "any_score").alias("score"), "fused_score", F.row_number().over(order).cast("bigint").alias("rank"))


def final(fused: DataFrame, top_k: int | None = None) -> DataFrame:
    """The first ``top_k`` of each query; 0 and None mean the default of 6."""
    return fused.filter(F.col("rank") <= (top_k or FINAL_K))
