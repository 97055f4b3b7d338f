"""Retrieval metrics, ground truth and detector validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("P@5", "R@5", "MRR", "nDCG@5", "P@10", "R@10", "nDCG@10")


def _gain(rank) -> F.Column:
    return 1.0 / F.log2(rank + 1.0)


def query_metrics(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10), totals: DataFrame | None = None) -> DataFrame:
    """(query_id, p_k, r_k, ndcg_k for each k, rr): one row for every query.

    ``ranked`` is (query_id, chunk_id, rank), ``relevant`` (query_id, chunk_id).
    Precision is over the rows actually returned, at most k. Queries without
    results or without relevant chunks score 0. The reciprocal rank is over all
    rows returned. With ``totals`` (query_id, n_rel), the number of a query's
    relevant chunks, ``relevant`` need only have those that are ranked.
    """
    truth = relevant.select("query_id", "chunk_id").distinct()
    if totals is None:
        totals = truth.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hits = ranked.select("query_id", "chunk_id", "rank").join(truth.withColumn("hit", F.lit(True)), ["query_id", "chunk_id"], "left")
    hit, rank = F.coalesce("hit", F.lit(False)), F.col("rank")
    sums = [F.min(F.when(hit, rank)).alias("first")]
    for k in ks:
        sums += [
            F.count_if(hit & (rank <= k)).alias(f"h_{k}"),
            F.count_if(rank <= k).alias(f"n_{k}"),
            # Gains by rank are summed in order, so the last digit doesn't depend on the shuffle.
            F.aggregate(
                F.array_sort(F.collect_list(F.when(hit & (rank <= k), rank.cast("int")))), F.lit(0.0), lambda s, r: s + _gain(r)
            ).alias(f"g_{k}"),
        ]
    per = queries.select("query_id").distinct().join(hits.groupBy("query_id").agg(*sums), "query_id", "left").join(totals, "query_id", "left")
    out = [F.col("query_id")]
    n_rel = F.coalesce("n_rel", F.lit(0))
    for k in ks:
        h, n = F.coalesce(f"h_{k}", F.lit(0)), F.coalesce(f"n_{k}", F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n_rel, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + _gain(r))
        out += [
            F.when(n > 0, h / F.greatest(n, F.lit(1))).otherwise(0.0).alias(f"p_{k}"),
            F.when(n_rel > 0, h / F.greatest(n_rel, F.lit(1))).otherwise(0.0).alias(f"r_{k}"),
            F.when(n_rel > 0, F.coalesce(f"g_{k}", F.lit(0.0)) / ideal).otherwise(0.0).alias(f"ndcg_{k}"),
        ]
    out.append(F.when(F.col("first") > 0, 1.0 / F.col("first")).otherwise(0.0).alias("rr"))
    return per.select(*out)


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """One row: the number of queries and the mean of each metric; 0 without queries."""
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(F.count("*").alias("n_queries"), *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in names))


def compare_systems(means: dict[str, DataFrame]) -> DataFrame:
    """(system, metrics..) in the order given; systems without a table are left out."""
    rows = [m.select(F.lit(i).alias("position"), F.lit(n).alias("system"), *m.columns) for i, (n, m) in enumerate(means.items()) if m is not None]
    return reduce(DataFrame.unionByName, rows)


def resolve_relevant(queries: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of all chunks of the relevant documents.

    ``queries`` has query_id and relevant_docs, an array of doc_keys. Raises
    if a key names no document.
    """
    asked = queries.select("query_id", F.explode("relevant_docs").alias("doc_key"))
    unknown = asked.join(documents, "doc_key", "left_anti").select("doc_key").distinct().limit(10).collect()
    if unknown:
        raise ValueError("ground truth names unknown documents: " + ", ".join(sorted(str(r[0]) for r in unknown)))
    ids = documents.select("doc_key", F.col("id").alias("document_id"))
    return asked.join(ids, "doc_key").join(chunks.select("document_id", "chunk_id"), "document_id").select("query_id", "chunk_id")


def resolve_snippets(cases: DataFrame, documents: DataFrame, chunks: DataFrame, doc: str, snippet: str, out: str) -> DataFrame:
    """Adds ``out``, the first chunk of ``doc`` with the snippet, else its first chunk, and whether it was found."""
    from docloom.functions.text import normalize_blanks

    ids = documents.select(F.col("doc_key").alias(doc), F.col("id").alias("document_id"))
    found = cases.join(ids, doc).join(chunks.select("document_id", "chunk_id", "chunk_index", "text"), "document_id")
    holds = F.contains(normalize_blanks("text"), normalize_blanks(snippet))
    best = F.coalesce(F.min_by(F.when(holds, F.col("chunk_id")), F.when(holds, F.col("chunk_index"))), F.min_by("chunk_id", "chunk_index"))
    per = found.groupBy("case_id").agg(best.alias(out), F.max(holds).alias(f"{out}_found"))
    return cases.join(per, "case_id")


def validate_pairs(truth: DataFrame, found: DataFrame, a: str, b: str, ordered: bool = False) -> DataFrame:
    """One row (hits, truth, found) of distinct pairs; unordered unless said otherwise."""

    def pairs(df: DataFrame) -> DataFrame:
        low, high = (F.col(a), F.col(b)) if ordered else (F.least(a, b), F.greatest(a, b))
        return df.select(low.alias("a"), high.alias("b")).distinct()

    t, f = pairs(truth), pairs(found)
    tagged = t.intersect(f).select(F.lit("hits").alias("k")).unionAll(t.select(F.lit("truth"))).unionAll(f.select(F.lit("found")))
    return tagged.agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("hits", "truth", "found")))
