"""Ingest, integrity, graph and streaming over small hand-made documents."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import components, graph, ingest, integrity, serving
from docloom.plans import knowledge_queries
from docloom.sources import documents as sources
from docloom.sources import records
from docloom.streaming.ingest import stream_ingest
from tests.test_oracles import SF

PAGE = """---
doc_key: {key}
title: "{title}"
department: {dept}
doc_type: Policy
version: "2.0"
effective_date: 2024-05-01
author: Jo Doe
owner: HR
authority_level: {level}
supersedes: {old}
tags: Leave, HR
---
# {title}

{body}
"""


def put(folder, key, title="A Leave Handbook", dept="HR", level=1, old="null", body="Leave is 20 days. More text follows."):
    path = folder / "sub" / f"{key}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(PAGE.format(key=key, title=title, dept=dept, level=level, old=old, body=body))
    return path


def test_front_matter(spark, tmp_path):
    put(tmp_path, "a")
    (tmp_path / "bad.md").write_text("no front matter")
    (tmp_path / "open.md").write_text("---\ntitle: x\n")
    (tmp_path / "part.md").write_text("---\ndoc_key: z\ntitle:\ndepartment: HR\ndoc_type: SOP\n---\nbody")
    rows = {r["source_path"].rsplit("/", 1)[1]: r for r in sources.parse_documents(sources.scan_files(spark, str(tmp_path))).collect()}
    a = rows["a.md"]
    assert (a["doc_key"], a["title"], a["version"], str(a["effective_date"]), a["authority_level"], a["status"]) == ("a", "A Leave Handbook", "2.0", "2024-05-01", 1, "current")
    assert a["supersedes_doc_key"] is None and a["created_date"] is None and a["raw_text"].startswith("# A Leave")
    assert rows["bad.md"]["error"] == "no front matter" and rows["open.md"]["error"] == "front matter isn't closed"
    assert rows["part.md"]["error"] == "missing: title"


def test_ingest_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    put(src, "a")
    put(src, "b", body="")
    first = ingest.ingest(spark, str(src), out).first()
    assert (first["documents"], first["chunks"]) == (2, 2)
    put(src, "c")
    again = ingest.ingest(spark, str(src), out).first()
    assert again["documents"] == 1
    assert sorted(r["id"] for r in records.read_table(spark, f"{out}/documents").collect()) == [1, 2, 3]
    assert ingest.upload_document(spark, "x.md", PAGE.format(key="d", title="T title", dept="HR", level=2, old="null", body="B."), out)["status"] == "ingested"
    assert ingest.upload_document(spark, "y.md", PAGE.format(key="d", title="T title", dept="HR", level=2, old="null", body="B."), out)["status"] == "skipped_duplicate"
    with pytest.raises(ValueError):
        ingest.upload_document(spark, "x.txt", "", out)
    put(src, "e").rename(src / "e2.md")
    put(src, "e")
    with pytest.raises(ValueError, match="repeated doc_key"):
        ingest.ingest(spark, str(src), out)
    with pytest.raises(FileNotFoundError):
        records.read_table(spark, str(tmp_path / "nothing"))


def test_stream(spark, tmp_path):
    src, out, check = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "check")
    put(src, "a")
    (src / "bad.md").write_text("nothing")
    stream_ingest(spark, str(src), out, check).awaitTermination()
    put(src, "b")
    stream_ingest(spark, str(src), out, check).awaitTermination()
    assert {r["doc_key"] for r in records.read_table(spark, f"{out}/documents").collect()} == {"a", "b"}
    assert records.read_table(spark, f"{out}/rejected").count() == 1


CHUNK = "chunk_id long, document_id long, doc_key string, department string, authority_level int, text string"
RULE = "Passwords must be changed every {} days."


def chunk_rows(*texts, departments=("HR", "Finance", "Projects"), levels=(1, 3, 2)):
    return [(i + 1, i + 1, f"d{i + 1}", departments[i], levels[i], t) for i, t in enumerate(texts)]


def no_versions(spark):
    return spark.createDataFrame([], "current_id long, outdated_id long")


def test_contradictions(spark):
    df = spark.createDataFrame(chunk_rows(RULE.format(90), RULE.format(180)), CHUNK)
    r = integrity.contradictions(df, no_versions(spark)).collect()
    assert [(x["concept"], x["value_a"], x["value_b"], x["severity"], x["resolved_doc_key"]) for x in r] == [("must be changed every", "90 days", "180 days", "medium", "d1")]
    assert integrity.contradictions(df, spark.createDataFrame([(2, 1)], "current_id long, outdated_id long")).count() == 0
    assert integrity.contradictions(spark.createDataFrame(chunk_rows(RULE.format(90), RULE.format(90)), CHUNK), no_versions(spark)).count() == 0
    assert integrity.contradictions(df.withColumn("document_id", F.lit(1).cast("long")), no_versions(spark)).count() == 0


def test_duplicates_of_copies_in_versions_and_documents(spark):
    t, u = "alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta theta iota"
    rng = random.Random(3)
    tables = [
        ([(1, 1, t), (2, 2, t), (3, 3, t)], [(2, 1)]),
        ([(1, 1, t), (2, 1, u), (3, 2, t), (4, 3, u)], []),
        ([(1, 1, t), (2, 1, t), (3, 2, u), (4, 2, t)], []),
    ]
    tables += [([(i, rng.randint(1, 4), rng.choice((t, u))) for i in range(1, 8)], [(2, 1), (3, 2)][: rng.randint(0, 2)]) for _ in range(3)]
    for rows, versions in tables:
        near = spark.createDataFrame(versions, "current_id long, outdated_id long")
        df = spark.createDataFrame(rows, "chunk_id long, document_id long, text string")
        right = {(a, b) for a, d, _ in rows for b, e, _ in rows if a < b and d != e and (d, e) not in versions and (e, d) not in versions}
        got = [(r[0], r[1]) for r in integrity.duplicate_pairs(df, near, 0.5).collect()]
        assert set(got) <= right and len(set(got)) == len(got)
        assert parts(got) == parts(right), (rows, versions)


def parts(pairs):
    groups = []
    for a, b in pairs:
        hit = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in hit] + [set().union({a, b}, *hit)]
    return sorted(map(sorted, groups))


def test_definition_conflicts(spark):
    a, b = "Customer is defined as a paying account.", "Customer is defined as anyone who saw an advert."
    df = spark.createDataFrame(chunk_rows(a, b, a), CHUNK)
    assert integrity.definition_conflicts(df).count() == 2
    assert integrity.definition_conflicts(df.withColumn("department", F.lit("HR"))).count() == 0


def test_duplicates(spark):
    t = "alpha beta gamma delta epsilon zeta eta theta"
    df = spark.createDataFrame(chunk_rows(t, t + " iota", "entirely different words stand here"), CHUNK)
    pairs = integrity.duplicate_pairs(df, no_versions(spark), 0.5)
    assert [(r["chunk_a_id"], r["chunk_b_id"]) for r in pairs.collect()] == [(1, 2)]
    assert integrity.duplicate_clusters(pairs).first()["cluster_id"] == 1
    assert integrity.duplicate_pairs(df.withColumn("document_id", F.lit(1).cast("long")), no_versions(spark), 0.5).count() == 0
    copies = spark.createDataFrame(chunk_rows(t, t, t), CHUNK)
    assert sorted((r[0], r[1], r[2]) for r in integrity.duplicate_pairs(copies, no_versions(spark), 0.5).collect()) == [(1, 2, 1.0), (1, 3, 1.0)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 3), (4, 5), (7, 7), (None, 1), (2, 1)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


DOC = "id long, doc_key string, title string, department string, doc_type string, owner string, author string, supersedes_doc_key string, tags string, raw_text string, first_chunk_id long"


def graph_docs(spark):
    rows = [
        (1, "leave-v1", "Annual Leave Policy", "HR", "Policy", "HR", "Jo Doe", None, "leave,hr", "Old rules.", 1),
        (2, "leave-v2", "Annual Leave Policy", "HR", "Policy", "HR", "HR Team", "leave-v1", "leave,hr", "See the Device\nUse Rules. The Platform team owns it.", 2),
        (3, "device", "Device Use Rules", "IT", "SOP", "IT", "Al Poe", None, "leave,it", "As in the annual leave policy.", 3),
        (4, "atlas", "Project Atlas Charter", "Projects", "ProjectDocumentation", "Marketing", None, None, None, "Customer means a payer.", 4),
    ]
    return spark.createDataFrame(rows, DOC)


def test_graph(spark):
    docs = graph_docs(spark)
    ents = graph.extract_entities(docs)
    names = {(r["entity_type"], r["name"]) for r in ents.collect()}
    assert {("Group", "Employees"), ("Policy", "leave-v1"), ("Process", "device"), ("Team", "Platform"), ("Project", "Project Atlas"), ("Concept", "Customer"), ("Person", "Jo Doe")} <= names
    assert ("Person", "HR Team") not in names
    rels = {(r["source"], r["relation_type"], r["target"]) for r in graph.extract_relations(docs).collect()}
    assert ("leave-v2", "references", "device") in rels and ("device", "references", "leave-v1") in rels
    assert ("leave-v2", "references", "leave-v1") not in rels
    assert ("atlas", "belongs_to", "Projects") in rels and ("leave-v1", "belongs_to", "HR") not in rels
    assert ("device", "related_to", "leave-v1") in rels and ("leave-v1", "related_to", "leave-v2") not in rels
    edges, unresolved = graph.resolve_edges(graph.extract_relations(docs), ents)
    assert unresolved.count() == 0
    start = ents.where(F.col("id") == graph.find_entity(ents, "ATLAS")).select("id")
    nodes, inside = graph.neighbourhood(ents, edges, start, 1)
    assert {r["name"] for r in nodes.collect()} == {"atlas", "Projects", "Marketing", "Project Atlas", "Customer"}
    assert inside.count() == 4
    with pytest.raises(ValueError):
        graph.neighbourhood(ents, edges, start, 4)


def test_parallel_edges_survive(spark):
    ents = spark.createDataFrame([(1, "a", "X"), (2, "b", "X"), (3, "c", "X")], "id long, name string, entity_type string")
    edges = spark.createDataFrame([(1, 2, "r", 1.0), (1, 2, "s", 1.0), (2, 3, "r", 1.0)], "source_entity_id long, target_entity_id long, relation_type string, confidence double")
    nodes, inside = graph.neighbourhood(ents, edges, ents.where("id = 1").select("id"), 1)
    assert {r["id"] for r in nodes.collect()} == {1, 2} and inside.count() == 2


def test_search_arguments():
    serving.check_search("bm25", 50, "q")
    for bad in (("x", 5, "q"), ("bm25", 0, "q"), ("bm25", 51, "q"), ("bm25", 5, " ")):
        with pytest.raises(ValueError):
            serving.check_search(*bad)


def test_dashboard_without_findings(spark):
    docs = spark.createDataFrame([(1, "current")], "id long, status string")
    none = spark.createDataFrame([], "cluster_id long")
    r = serving.dashboard(docs, docs, docs, none, none).first()
    assert r["integrity_score"] is None and r["documents"] == 1
    assert serving.dashboard(docs, docs, docs, docs.union(docs), none).first()["integrity_score"] == -100.0


def test_neighbourhood_query_takes_every_kind_of_edge(spark):
    base = knowledge_queries.Base(spark, SF)
    edges = [r.asDict() for r in base.edges().unionByName(base.found_edges()).collect()]
    ids = {r["name"].lower(): r["id"] for r in base.entities().collect()}
    reached = {ids["doc-10"]}
    for _ in range(2):
        ends = [(e["source_entity_id"], e["target_entity_id"]) for e in edges]
        reached |= {v for u, v in ends if u in reached} | {u for u, v in ends if v in reached}
    want = [e for e in edges if {e["source_entity_id"], e["target_entity_id"]} <= reached]
    got = [r.asDict() for r in knowledge_queries.neighbourhood_k2(spark, SF).collect()]
    assert ids["employees"] in reached and any(e["relation_type"] == "applies_to" for e in got)
    assert sorted(map(str, got)) == sorted(map(str, ({k: e[k] for k in got[0]} for e in want)))
