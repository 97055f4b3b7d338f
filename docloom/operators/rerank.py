"""Reranking of candidates by TF-IDF cosine, fitted anew for each query."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.fixed import POOL, STOPWORDS
from docloom.functions.text import ngram_terms
from docloom.operators.bm25 import DIGITS, top_ranked


class Reranker(Protocol):
    """What a reranker must do; a model that scores pairs may stand behind it."""

    def rerank(self, candidates: DataFrame, queries: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
        """(query_id, chunk_id, score, rank) of the candidates (query_id, chunk_id, rank)."""


def tfidf_weights(terms: DataFrame, group: list[str], doc: str, n: DataFrame | None = None) -> DataFrame:
    """L2-normalised smoothed TF-IDF of rows (group.., doc, term), counted within each group.

    ``n`` has the number of texts of a group; without it, texts without terms don't count.
    """
    tf = terms.groupBy(*group, doc, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*group, "term").agg(F.count("*").alias("df"))
    if n is None:
        n = tf.groupBy(*group).agg(F.countDistinct(doc).alias("n"))
    weighed = tf.join(df, [*group, "term"])
    weighed = weighed.join(n, group) if group else weighed.crossJoin(F.broadcast(n))
    weighed = weighed.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms = weighed.groupBy(*group, doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, [*group, doc]).select(*group, doc, "term", (F.col("w") / F.col("norm")).alias("w"))


class TfidfReranker:
    """Scores candidates by cosine to the query, both in the TF-IDF of query and candidates."""

    def __init__(self, stop_words: Sequence[str] = STOPWORDS, pool: int = POOL) -> None:
        self.stop_words, self.pool = stop_words, pool

    def rerank(self, candidates: DataFrame, queries: DataFrame, chunks: DataFrame, top_k: int = 10) -> DataFrame:
        """(query_id, chunk_id, score, rank) of the best ``pool`` candidates.

        ``queries`` is (query_id, text), ``chunks`` (chunk_id, text). Candidates
        without a shared term score 0 and stay, ties in their old order.
        """
        kept = candidates.where(F.col("rank") <= self.pool).select("query_id", "chunk_id", F.col("rank").alias("fused_rank"))
        texts = kept.join(chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "chunk_id", "text")
        asked = queries.join(kept.select("query_id").distinct(), "query_id", "left_semi")
        # The query takes part as a text of its own, with a null chunk as its mark.
        both = texts.unionByName(asked.select("query_id", F.lit(None).cast("bigint").alias("chunk_id"), "text"))
        # One shuffle, of texts to their query; counts, weights and sums of a query are made where its texts are.
        both = both.repartition("query_id").withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
        terms = both.select("query_id", "chunk_id", "n", F.explode(ngram_terms("text", self.stop_words)).alias("term"))
        tf = terms.groupBy("query_id", "chunk_id", "n", "term").agg(F.count("*").alias("tf"))
        of_term, of_text = Window.partitionBy("query_id", "term"), Window.partitionBy("query_id", "chunk_id")
        weighed = tf.withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.count("*").over(of_term))) + 1))
        weighed = weighed.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(of_text)))
        weighed = weighed.withColumn("q", F.max(F.when(F.col("chunk_id").isNull(), F.col("w"))).over(of_term))
        shared = weighed.where("chunk_id IS NOT NULL AND q IS NOT NULL")
        cosine = shared.groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("q")).alias("s"))
        scored = kept.join(cosine, ["query_id", "chunk_id"], "left")
        scored = scored.withColumn("score", F.round(F.coalesce("s", F.lit(0.0)), DIGITS))
        return top_ranked(scored, top_k, [F.desc("score"), F.asc("fused_rank")]).select("query_id", "chunk_id", "score", "rank")
