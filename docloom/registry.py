"""All core queries and their reference SQL, collected from the plan modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import knowledge_queries, retrieval_queries, service_queries, text_queries

_MODULES = (text_queries, retrieval_queries, knowledge_queries, service_queries)
QUERIES: dict = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval with reranking over the documents table."""
    return retrieval_queries.hybrid_rerank(spark, sf_dir)
