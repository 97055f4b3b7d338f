"""Rounding, facts, name resolution, repairs and builds over small hand-made tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import facts, fixed
from docloom.functions.text import half_even
from docloom.operators import builds, graph, ingest, integrity, serving
from docloom.operators.dense import _best
from docloom.plans import tables
from docloom.plans.tables import materialize, new_path, running_totals, sized
from docloom.sources import records
from tests.test_collection import CHUNK, chunk_rows, graph_docs, no_versions, put


def test_half_even_rounds_like_python(spark):
    rng = random.Random(1)
    xs = [rng.uniform(-500, 500) for _ in range(500)] + [k / 20 for k in range(-400, 400)] + [100 * (1 - k / 2000) for k in range(3000, 9000, 7)] + [0.0, 12345.65]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", half_even(F.col("x"), 1).alias("y")).collect()
    assert all(r["y"] == round(r["x"], 1) for r in rows)


def brute_facts(text):
    text, out = text.lower(), []
    for unit, pattern in fixed.UNIT_PATTERNS:
        for m in re.finditer(pattern, text, re.ASCII):
            words = [w for w in re.findall("[a-z]+", text[: m.start()]) if w not in fixed.CONTEXT_STOPWORDS]
            out.append((unit, int(m[1].replace(",", "")), f"{unit}::" + " ".join(words[-fixed.CONTEXT_WORDS :]), m[0]))
    return sorted(out)


def test_numeric_facts_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["the", "Password", "lasts", "5 days", "7 day", "$1,500", "$ 20", "30%", "of", "x9", "12 weeks.", "3 months,", "$", "days", "2 years\n", "été", "a-b", "10daysx", "$5k"]
    texts = ["", "no numbers", "5 days"] + [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    got = {}
    for r in facts.numeric_facts(df).collect():
        got.setdefault(r["chunk_id"], []).append((r["unit"], r["value"], r["context_key"], r["raw_match"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_facts(t), t


def test_contradictions_give_values_as_they_stand(spark):
    df = spark.createDataFrame(chunk_rows("Orders above $1,500 need approval.", "Orders above $2,500 need approval."), CHUNK)
    r = integrity.contradictions(df, no_versions(spark)).first()
    assert (r["value_a"], r["value_b"]) == ("$1,500", "$2,500")


def test_names_resolve_to_the_first_entity_whatever_its_type(spark):
    ents = spark.createDataFrame([(1, "Marketing", "Department"), (2, "Marketing", "Team"), (3, "d", "Policy")], "id long, name string, entity_type string")
    rels = spark.createDataFrame(
        [("Marketing", "Team", "d", "Document", "manages", 0.9, 1), ("Marketing", "Department", "d", "Document", "manages", 0.4, 0), ("zz", "Team", "d", "Document", "manages", 0.9, 1)],
        "source string, source_type string, target string, target_type string, relation_type string, confidence double, step int",
    )
    edges, bad = graph.resolve_edges(rels, ents)
    assert [tuple(r) for r in edges.collect()] == [(1, 3, "manages", 0.4)] and bad.count() == 1
    typed, _ = graph.resolve_edges(rels, ents, typed=True)
    assert sorted(r["source_entity_id"] for r in typed.collect()) == [1, 2]


def test_chunks_of_a_run_that_broke_off_are_replaced(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    put(src, "a")
    ingest.ingest(spark, str(src), out)
    # A run that wrote its chunks and no documents.
    records.write_table(spark.createDataFrame([(2, 0, "lost", 1, 2)], "document_id long, chunk_index int, text string, token_count int, id long"), f"{out}/chunks")
    put(src, "b")
    assert ingest.ingest(spark, str(src), out).first()["documents"] == 1
    docs = {r["id"] for r in records.read_table(spark, f"{out}/documents").collect()}
    chunks = records.read_table(spark, f"{out}/chunks").collect()
    assert docs == {1, 2} == {r["document_id"] for r in chunks} and "lost" not in {r["text"] for r in chunks}


def test_listings(spark):
    conflicts = spark.createDataFrame(
        [(1, 2, "contradiction", "high"), (3, 4, "definition", "medium"), (5, 6, "contradiction", "low")], "chunk_a_id long, chunk_b_id long, conflict_type string, severity string"
    )
    assert serving.list_conflicts(conflicts, "contradiction", "low").first()["chunk_a_id"] == 5
    assert [r["chunk_a_id"] for r in serving.preview_conflicts(conflicts).collect()] == [1, 3]
    dups = spark.createDataFrame([(1, 2, 0.7, 1), (1, 3, 0.9, 1)], "chunk_a_id long, chunk_b_id long, similarity_score double, cluster_id long")
    chunks = spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (3, 1, "z")], "chunk_id long, document_id long, text string")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, doc_key string")
    for c in ("title", "department", "authority_level", "version", "effective_date"):
        docs = docs.withColumn(c, F.lit("t"))
    assert [(r["doc_key_a"], r["doc_key_b"]) for r in serving.list_duplicates(dups, chunks, docs).collect()] == [("a", "a"), ("a", "b")]
    cases = spark.createDataFrame([("CTR-10", "CTR", "low", 1), ("CTR-9", "CTR", "low", 1), ("OUT-001", "OUT", "medium", 2)], "case_id string, kind string, severity string, severity_rank int")
    assert [r["case_id"] for r in serving.order_cases(cases).collect()] == ["OUT-001", "CTR-9", "CTR-10"]
    assert serving.filter_cases(cases, ("CTR",), ("low",)).count() == 2 and serving.filter_cases(cases).count() == 3
    first = serving.first_chunks(spark.createDataFrame([(1, 7, 1), (1, 9, 0), (2, 3, 4)], "document_id long, chunk_id long, chunk_index int"))
    assert sorted(tuple(r) for r in first.collect()) == [(1, 9), (2, 3)]
    assert serving.count_map(docs, "doc_key", "m").first()["m"] == {"a": 1, "b": 1}


def test_builds_replace_their_tables(spark):
    folder = new_path(spark, "builds-test")
    docs = graph_docs(spark).drop("first_chunk_id")
    chunks = docs.select(
        F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), "doc_key", "department", F.lit(1).alias("authority_level"), F.col("raw_text").alias("text")
    )
    assert builds.run_integrity(spark, docs, chunks, folder).first()["integrity_edges"] == 0
    first = builds.build_graph(spark, docs, chunks, folder).first()
    again = builds.build_graph(spark, docs, chunks, folder).first()
    assert first == again and first["entities"] > 5
    assert builds.run_integrity(spark, docs, chunks, folder).first()["outdated"] == 1
    assert spark.read.json(f"{folder}/results/outdated").count() == 1
    with pytest.raises(ValueError):
        builds.build_graph(spark, docs.limit(0), chunks, folder)


def test_similar_pairs_equal_all_pairs(spark):
    rng = random.Random(6)
    rows, dense = [], {}
    for d in range(60):
        base = {t: rng.random() for t in rng.sample(range(200), 12)} | {t: rng.random() * rng.choice((0.1, 3)) for t in range(200, 206)}
        if d % 3:
            base = {t: w * rng.uniform(0.5, 1.5) for t, w in dense[d - 1].items() if rng.random() < 0.9}
        dense[d] = base
    for d, base in dense.items():
        norm = sum(w * w for w in base.values()) ** 0.5
        dense[d] = {t: w / norm for t, w in base.items()}
        rows += [(d, f"t{t}", w) for t, w in dense[d].items()]
    df = spark.createDataFrame(rows, "chunk_id long, term string, w double")
    for threshold in (0.3, 0.6, 0.9):
        want = {(a, b) for a in dense for b in dense if a < b and round(sum(w * dense[b].get(t, 0) for t, w in dense[a].items()), 6) >= threshold}
        assert {(r["a"], r["b"]) for r in integrity.similar_pairs(df, threshold).collect()} == want


def test_running_totals_and_numbers(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randint(0, 9) or None) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, s string, n long")
    got = {r["i"]: (r["before"], r["rank"]) for r in running_totals(df, ["s", "i"], {"before": F.col("n"), "rank": F.lit(1)}).collect()}
    total = 0
    for k, (i, _, n) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        assert got[i] == (total, k)
        total += n or 0
    assert running_totals(df.limit(0), ["s", "i"], {"before": F.col("n")}).count() == 0
    assert sorted(r["no"] for r in ingest.number_rows(df, ["i"], 7, "no").collect()) == list(range(7, 507))


def test_only_small_tables_are_broadcast(spark, monkeypatch):
    small = materialize(spark.createDataFrame([(1, "x" * 100)], "i long, t string"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(sized(small)) and not hinted(sized(small, 50))
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 10)
    assert not hinted(sized(small))


def test_best_of_scores_with_ties_and_repeated_chunks():
    rng = np.random.default_rng(0)
    for _ in range(100):
        q, n = rng.integers(1, 6), int(rng.integers(3, 40))
        k = int(rng.integers(1, n))
        score, chunk = rng.integers(0, 6, (q, n)).astype(float), rng.integers(0, n, (q, n))
        a, b = _best(score, chunk, k)
        for i in range(q):
            assert sorted(zip(-a[i], b[i], strict=True)) == sorted(zip(-score[i], chunk[i], strict=True))[:k]


def test_lookup(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, key string")
    assert serving.lookup(rows, "id", [2]).count() == 2
    assert serving.lookup(rows, "id", spark.createDataFrame([(1,), (9,), (1,)], "id long")).count() == 1
    with pytest.raises(LookupError, match="9"):
        serving.lookup(rows, "id", [1, 9])


def test_stop_words_from_a_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("The\n\nof \nthe\n")
    words = records.read_words(spark, str(tmp_path / "words.txt"))
    assert words == ("of", "the")
    chunks = spark.createDataFrame([(1, 1, "the of alpha beta"), (2, 2, "alpha beta")], "chunk_id long, document_id long, text string")
    assert integrity.duplicate_pairs(chunks, no_versions(spark), 0.99, words).count() == 1
