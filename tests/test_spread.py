"""Steps that must not grow faster than their input: how work is spread and what is shuffled."""

import numpy as np
import pyarrow as pa

from docloom.operators import builds, dense, graph
from docloom.plans import adapters, retrieval_queries
from tests.test_oracles import SF

DOC = "id long, doc_key string, title string, department string, doc_type string, owner string, author string, supersedes_doc_key string, tags string, raw_text string, first_chunk_id long"


def _tagged(spark, rows):
    full = [(i, k, title, "HR", "Policy", None, "Ann", old, tags, "", i) for i, (k, title, old, tags) in enumerate(rows, 1)]
    return spark.createDataFrame(full, DOC)


def test_documents_of_one_small_file_fill_all_tasks(spark):
    assert adapters.documents(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_tag_pairs_are_not_shuffled(spark):
    plan = graph.tag_relations(adapters.documents(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join Inner")] and "LeftAnti" not in plan[: plan.index("Join Inner")]


def test_edges_equal_resolved_relations(spark, monkeypatch):
    # Project Q is a key and a project's name; p1 and p2 share two tags; p3 supersedes p1; p4's key has no other tag than a large one.
    rows = [("Project Q", "Charter", None, "x, big"), ("A", "Project Q Plan", None, "x"), ("p1", "One", None, "s,t"), ("p2", "Two", None, "t,s"), ("p3", "Three", "p1", "t"), ("p4", "Four", None, "hr")]
    docs = _tagged(spark, rows + [(f"m{i:02}", "Many", None, "big") for i in range(40)]).cache()
    entities = graph.extract_entities(docs).where("name <> 'm07'").cache()
    relations = graph.extract_relations(docs).cache()
    want, unresolved = graph.resolve_edges(relations, entities)
    key = lambda df: sorted(map(tuple, df.select("source_entity_id", "target_entity_id", "relation_type", "confidence").collect()))
    want = key(want)
    tags = sorted((r["source"], r["target"]) for r in graph.tag_relations(docs).collect())
    member = ["Project Q", *(f"m{i:02}" for i in range(40))]
    big = [(a, b) for a in member for b in member if a < b]
    assert tags == sorted([*big, ("A", "Project Q"), ("p1", "p2"), ("p2", "p3")])
    monkeypatch.setattr(graph, "TAG_MEMBERS", 7)
    edges = graph.Edges(docs, entities)
    assert key(edges.all()) == want
    assert edges.tallies().first().asDict() == {"found": relations.count(), "created": len(want), "skipped_unresolved": unresolved.count()}
    some = {r["id"] for r in entities.where("name IN ('A', 'm03', 'm04', 'HR')").collect()}
    ids = spark.createDataFrame([(i,) for i in some], "id long")
    assert key(edges.touching(ids)) == [e for e in want if e[0] in some or e[1] in some]
    assert key(edges.among(ids)) == [e for e in want if e[0] in some and e[1] in some]


def test_search_holds_few_products_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    queries, corpus, widths, best = rng.random((300, 4)), rng.random((5000, 4)), [], dense._best
    monkeypatch.setattr(dense, "_best", lambda score, chunk, k: widths.append(score.size) or best(score, chunk, k))
    monkeypatch.setattr(dense, "HELD_PRODUCTS", 30_000)
    shared = type("Shared", (), {"value": (np.arange(300), queries)})
    batch = pa.record_batch([pa.array(range(5000)), pa.array(corpus.tolist(), pa.list_(pa.float64()))], ["chunk_id", "embedding"])
    (out,) = dense._scan(shared, 10)([batch])
    assert max(widths) <= 30_000 + 300 * 10
    got = np.sort(np.array(out["chunk_id"]).reshape(300, 10), axis=1)
    assert (got == np.sort(np.argsort(-np.round(queries @ corpus.T, dense.DIGITS), axis=1, kind="stable")[:, :10], axis=1)).all()


def test_relevant_vectors_are_counted_not_listed(spark):
    rows = retrieval_queries._by_label(spark, SF, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct vec_id" in rows


def test_chunks_are_cut_once(spark, monkeypatch):
    seen, number = [], adapters.number_rows
    monkeypatch.setattr(adapters, "number_rows", lambda rows, *rest: seen.append(rows) or number(rows, *rest))
    adapters.real_chunks(adapters.documents(spark, SF))
    assert "regexp" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_builds_do_not_shuffle_tag_pairs(spark, monkeypatch, tmp_path):
    plans, write = {}, builds.write_table
    monkeypatch.setattr(builds, "write_table", lambda df, folder, reset=False: plans.update({folder.rsplit("/", 1)[1]: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, folder, reset))
    docs = _tagged(spark, [("a", "One", None, "x"), ("b", "Two", None, "x")]).drop("first_chunk_id")
    chunks = docs.selectExpr("id as chunk_id", "id as document_id", "0 as chunk_index")
    row = builds.build_graph(spark, docs, chunks, str(tmp_path)).first()
    # A department, Ann and the group for both; a document applies to the group.
    assert row.asDict() == {"entities": 5, "relationships": 7}
    assert "Aggregate" not in plans["relationships"][: plans["relationships"].index("Join Inner")]
