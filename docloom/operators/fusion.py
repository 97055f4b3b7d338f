"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.fixed import POOL, RRF_K
from docloom.operators.bm25 import top_ranked


def reciprocal_rank_fusion(lists: list[DataFrame], top_k: int | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, rank) from lists (query_id, chunk_id, rank).

    The score is the sum of 1 / (k + rank) over the lists that have the chunk.
    Ties go to the better rank in the first list, then in the next; a list that
    lacks the chunk comes last.
    """
    tagged = reduce(
        DataFrame.unionByName, [d.select("query_id", "chunk_id", "rank", F.lit(i).alias("list_no")) for i, d in enumerate(lists)]
    )
    ranks = [F.min(F.when(F.col("list_no") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(lists))]
    scored = tagged.groupBy("query_id", "chunk_id").agg(*ranks)
    # Summed in the order of lists, so that the last digit doesn't depend on the shuffle.
    total = sum((F.coalesce(1.0 / (k + F.col(f"rank_{i}")), F.lit(0.0)) for i in range(1, len(lists))), F.coalesce(1.0 / (k + F.col("rank_0")), F.lit(0.0)))
    scored = scored.withColumn("score", F.round(total, 9))
    order = [F.desc("score"), *(F.asc_nulls_last(f"rank_{i}") for i in range(len(lists))), F.asc("chunk_id")]
    ranked = top_ranked(scored, top_k or 1 << 30, order)
    return ranked.select("query_id", "chunk_id", "score", "rank")


def hybrid(bm25: DataFrame, dense: DataFrame, top_k: int = 10, pool: int = POOL) -> DataFrame:
    """Fusion of the best ``pool`` of keyword and of vector search; at most twice ``pool`` rows a query."""
    return reciprocal_rank_fusion([bm25.where(F.col("rank") <= pool), dense.where(F.col("rank") <= pool)], top_k)
