import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import bm25, dense, evaluation, fusion, lsa
from docloom.operators.lsa import LsaEncoder
from docloom.operators.rerank import TfidfReranker
from docloom.plans.tables import new_path

CHUNKS = [
    (1, "Staff may work from home three days a week."),
    (2, "Travel costs are paid back within thirty days of the trip."),
    (3, "Every password is changed each quarter under the security rules."),
    (4, "Access to the production database needs approval by a lead."),
    (5, "Production database backups run every night."),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, text string")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def ranked(df):
    return [(r["chunk_id"]) for r in df.orderBy("query_id", "rank").collect()]


def test_bm25(spark, chunks):
    index = bm25.build_bm25(chunks)
    assert ranked(bm25.bm25_search(index, ask(spark, "work from home"), 3))[0] == 1
    assert set(ranked(bm25.bm25_search(index, ask(spark, "production database"), 5))) == {4, 5}
    assert ranked(bm25.bm25_search(index, ask(spark, "zebra"), 5)) == []
    folder = new_path(spark, "bm25")
    index.save(folder)
    again = bm25.Bm25Index.load(spark, folder)
    assert ranked(bm25.bm25_search(again, ask(spark, "password rules"), 5)) == ranked(bm25.bm25_search(index, ask(spark, "password rules"), 5))
    with pytest.raises(ValueError):
        bm25.build_bm25(chunks.limit(0))


def test_knn_blocks_and_ties(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(99, None)], "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "query_id long, embedding array<float>")
    for block in (1, 2, 100):
        assert ranked(dense.knn(vectors, queries, 4, block=block)) == [2, 5, 8, 1] * 5
    assert dense.knn(vectors, queries, 50).count() == 45
    assert dense.knn(vectors, queries.limit(0), 3).count() == 0


def test_fusion(spark):
    make = lambda ids: spark.createDataFrame([(0, c, r + 1) for r, c in enumerate(ids)], "query_id long, chunk_id long, rank long")
    out = fusion.reciprocal_rank_fusion([make([1, 2, 3]), make([2, 1, 4])])
    assert ranked(out) == [1, 2, 3, 4]
    assert ranked(fusion.reciprocal_rank_fusion([make([5, 3, 8])])) == [5, 3, 8]
    assert fusion.reciprocal_rank_fusion([make([1]).limit(0), make([1]).limit(0)]).count() == 0
    first = out.orderBy("rank").first()
    assert abs(first["score"] - (1 / 61 + 1 / 62)) < 1e-9


def test_rerank(spark, chunks):
    cands = spark.createDataFrame([(0, c, c) for c in (1, 2, 3, 4, 5)], "query_id long, chunk_id long, rank long")
    out = TfidfReranker().rerank(cands, ask(spark, "how often is the password changed under the security rules"), chunks, 5)
    assert ranked(out)[0] == 3 and out.count() == 5
    assert TfidfReranker().rerank(cands.limit(0), ask(spark, "x"), chunks).count() == 0


def test_lsa(spark, chunks):
    encoder = LsaEncoder(dims=4, stop_words=("the", "of"))
    with pytest.raises(RuntimeError):
        encoder.encode(chunks)
    encoder.fit(chunks)
    for r in encoder.encode(chunks).collect():
        assert abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5
    index = dense.DenseIndex.build(chunks, encoder)
    assert set(ranked(index.search(ask(spark, "production database"), encoder, 2))) == {4, 5}
    folder = new_path(spark, "dense")
    index.save(folder)
    encoder.save(spark, folder + "/lsa")
    loaded = LsaEncoder.load(spark, folder + "/lsa", stop_words=("the", "of"))
    assert ranked(dense.DenseIndex.load(spark, folder, "lsa").search(ask(spark, "password"), loaded, 1)) == [3]
    with pytest.raises(ValueError):
        dense.DenseIndex.load(spark, folder, "other")


METRICS = [
    ([1, 2, 3, 4, 5], {3}, 0.2, 1.0, 1 / 3, 0.5),
    ([], {1, 2}, 0.0, 0.0, 0.0, 0.0),
    ([1, 2, 3, 4, 5], set(), 0.0, 0.0, 0.0, 0.0),
    ([1, 2, 3], {1, 2, 3}, 1.0, 1.0, 1.0, 1.0),
    ([1, 2, 3, 4, 5], {3, 10}, 0.2, 0.5, 1 / 3, None),
]


def test_metrics(spark):
    queries = spark.createDataFrame([(i,) for i in range(len(METRICS))], "query_id long")
    results = spark.createDataFrame([(i, c, r + 1) for i, m in enumerate(METRICS) for r, c in enumerate(m[0])], "query_id long, chunk_id long, rank long")
    relevant = spark.createDataFrame([(i, c) for i, m in enumerate(METRICS) for c in m[1]], "query_id long, chunk_id long")
    out = {r["query_id"]: r for r in evaluation.query_metrics(queries, results, relevant, (5,)).collect()}
    for i, (_, _, p, r, rr, ndcg) in enumerate(METRICS):
        assert (out[i]["p_5"], out[i]["r_5"]) == (p, r) and abs(out[i]["rr"] - rr) < 1e-12
        assert ndcg is None or abs(out[i]["ndcg_5"] - ndcg) < 1e-12
    means = evaluation.mean_metrics(evaluation.query_metrics(queries.limit(0), results, relevant, (5,))).first()
    assert means["n_queries"] == 0 and means["p_5"] == 0.0


def test_ground_truth(spark, chunks):
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "doc_key string, id long")
    parts = spark.createDataFrame([(1, 10, 0, "first part"), (1, 11, 1, "the  second\npart"), (2, 20, 0, "b")], "document_id long, chunk_id long, chunk_index int, text string")
    asked = spark.createDataFrame([("q", ["a"])], "query_id string, relevant_docs array<string>")
    assert {r["chunk_id"] for r in evaluation.resolve_relevant(asked, docs, parts).collect()} == {10, 11}
    with pytest.raises(ValueError):
        evaluation.resolve_relevant(asked.withColumn("relevant_docs", F.array(F.lit("zz"))), docs, parts)
    cases = spark.createDataFrame([("c1", "a", "second part"), ("c2", "a", "nowhere")], "case_id string, doc string, snippet string")
    got = {r["case_id"]: (r["chunk"], r["chunk_found"]) for r in evaluation.resolve_snippets(cases, docs, parts, "doc", "snippet", "chunk").collect()}
    assert got == {"c1": (11, True), "c2": (10, False)}


def test_lsa_equals_a_dense_svd(spark):
    """Cosines of projected texts, by either side of the matrix, against numpy's SVD over all terms."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(f"a{k} b{k} c{k} d{k} e{k} f{k} g{k}".split()) for _ in range(30)) for k in [0, 1, 2, 3] * 6]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = ["a0 b0 c0", "d1 e1 a2", "zebra", ""]

    def grams(t):
        w = t.split()
        return w + [f"{x} {y}" for x, y in zip(w, w[1:], strict=False)]

    vocabulary = sorted({g for t in texts for g in grams(t)})
    idf = {g: math.log((1 + len(texts)) / (1 + sum(g in grams(t) for t in texts))) + 1 for g in vocabulary}

    def vector(t):
        v = np.array([grams(t).count(g) * idf[g] for g in vocabulary])
        return v / (np.linalg.norm(v) or 1)

    matrix = np.array([vector(t) for t in texts])
    v = np.linalg.svd(matrix, full_matrices=False)[2][:4].T
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = unit(np.array([vector(t) for t in asked]) @ v) @ unit(matrix @ v).T
    for bound in (None, 10**6):
        encoder = LsaEncoder(dims=4, max_features=bound, stop_words=(), steps=40).fit(df)
        made = {r["chunk_id"]: np.array(r["embedding"]) for r in encoder.encode(df).collect()}
        queries = {r["query_id"]: np.array(r["embedding"]) for r in encoder.encode(ask(spark, *asked), "query_id").collect()}
        got = np.array([[queries[i] @ made[j] for j in range(len(texts))] for i in range(len(asked))])
        assert np.abs(got - want).max() < 1e-4, bound
    with pytest.raises(ValueError):
        LsaEncoder().fit(df.limit(0))


def test_lsa_refuses_what_the_driver_cannot_hold(spark, chunks, monkeypatch):
    monkeypatch.setattr(lsa, "HELD_BYTES", 16)
    with pytest.raises(ValueError, match="max_features"):
        LsaEncoder().fit(chunks)


def test_lsa_query_takes_all_terms():
    found = LsaEncoder()
    assert (found.dims, found.max_features) == (100, None)
