"""Duplicates: what is moved and which pairs meet."""

from collections import Counter

from pyspark.sql import functions as F

from docloom.functions.text import term_counts
from docloom.operators import integrity


def test_terms_are_counted_in_their_row(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, ["c"]), (4, ["x"] * 5)]
    df = spark.createDataFrame(rows, "i long, ts array<string>").select("i", term_counts(F.col("ts")).alias("c"))
    assert {r["i"]: {c["term"]: c["tf"] for c in r["c"]} for r in df.collect()} == {i: dict(Counter(ts)) for i, ts in rows}


def test_pairs_of_frequent_terms_do_not_meet(spark):
    # Forty vectors that share only a term every one of them has, at a tail that lies in the prefix of each.
    rows = [(d, t, w) for d in range(40) for t, w in (("all", 0.7), (f"own{d}", 0.5), (f"pair{d // 2}", 0.51))]
    prefix = spark.createDataFrame([(d, t, w, 0.7 if t == "all" else 0.87) for d, t, w in rows if not t.startswith("own")], "d long, term string, w double, tail double")
    assert {(r["a"], r["b"]) for r in integrity._met(prefix, 0.85 * 0.6).collect()} == {(d, d + 1) for d in range(0, 40, 2)}
    vectors = spark.createDataFrame(rows, "chunk_id long, term string, w double")
    assert integrity.similar_pairs(vectors, 0.6).count() == 20


def test_duplicates_move_no_texts_of_terms(spark, monkeypatch):
    seen, write = [], integrity.materialize
    monkeypatch.setattr(integrity, "materialize", lambda df, label="table": seen.append((label, df.dtypes)) or write(df, label))
    chunks = spark.createDataFrame([(1, 1, "alpha beta gamma"), (2, 2, "alpha beta gamma delta"), (3, 3, "alpha beta gamma"), (4, 4, None)], "chunk_id long, document_id long, text string")
    none = spark.createDataFrame([], "current_id long, outdated_id long")
    assert sorted((r[0], r[1]) for r in integrity.duplicate_pairs(chunks, none, 0.5).collect()) == [(1, 2), (1, 3)]
    assert not [(label, c) for label, types in seen for c, t in types if "string" in t]
