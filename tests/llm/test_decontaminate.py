import re

from docloom.llm import decontaminate as dc
from docloom.plans import tables
from tests.llm.helpers import SF, docs, same_as_oracle, tuples

ITEM = "item_id long, text string"
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingles(ws, n):
    return {" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def brute(documents, items, threshold=0.8):
    out = []
    for d, t in documents:
        for i, q in items:
            w = words(q)
            if w:
                n = min(5, len(w))
                s = shingles(w, n)
                if len(s & shingles(words(t), n)) / len(s) >= threshold:
                    out.append((d, i))
    return sorted(set(out), key=str)


def test_whole_table_equals_sql(spark):
    same_as_oracle(dc.op5_decontamination(spark, SF), dc.OP5_SQL)


def test_short_items_long_documents_and_edits(spark):
    ws = TEXT.split()
    rows = [
        (1, "x y z " * 3000 + TEXT.upper() + " a b" * 3000),
        (2, " ".join(ws[:13])),
        (3, " ".join(ws[:12])),
        (4, " ".join(ws[:7] + ["changed"] + ws[8:])),
        (5, None),
        (6, ""),
        (7, "só três"),
        (8, "-- Só,\ntrês!"),
        (None, TEXT.replace(" ", ",\n")),
        (1, "clean"),
    ]
    items = [(1, TEXT), (2, "só três"), (3, ""), (4, None), (5, "eight"), (6, TEXT + " " + TEXT), (7, "no such words at all in here")]
    found = dc.find_leaks(docs(spark, rows), spark.createDataFrame(items, ITEM))
    assert sorted({(r["doc_id"], r["item_id"]) for r in found.collect()}, key=str) == brute(rows, items)


def test_threshold_is_exact_over_sizes(spark):
    """Items of many sizes, each with just enough and just too few shingles left in a document."""
    items, rows = [], []
    for n in range(1, 60):
        ws = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(ws)))
        total = max(1, n - 4)
        for lost in range(total + 1):
            if abs((total - lost) / total - 0.8) < 0.15:
                rows.append((n * 100 + lost, " ".join(ws[: n - lost])))
    found = dc.find_leaks(docs(spark, rows), spark.createDataFrame(items, ITEM))
    assert sorted(tuples(found, "doc_id", "item_id"), key=str) == brute(rows, items)


def test_large_sketches_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    same_as_oracle(dc.op5_decontamination(spark, SF), dc.OP5_SQL)


def test_drop_keeps_clean_rows_and_columns(spark):
    df = docs(spark, [(1, TEXT), (1, "clean"), (2, None), (None, TEXT), (None, "fine"), (3, TEXT), (3, TEXT)]).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "h")
    kept = dc.drop_leaks(df, spark.createDataFrame([(1, TEXT)], ITEM))
    assert kept.columns == df.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == ["(1, 'clean')", "(2, None)", "(None, 'fine')"]


def test_empty_tables_and_repeated_items(spark):
    items = spark.createDataFrame([(1, TEXT), (1, TEXT)], ITEM)
    assert dc.find_leaks(docs(spark, []), items).count() == 0
    assert dc.find_leaks(docs(spark, [(1, TEXT)]), items.limit(0)).count() == 0
    assert dc.drop_leaks(docs(spark, [(1, TEXT)]), items.limit(0)).count() == 1
    assert tuples(dc.find_leaks(docs(spark, [(1, TEXT), (1, TEXT)]), items), "doc_id", "item_id") == [(1, 1)]


def test_many_candidates_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    same_as_oracle(dc.op5_decontamination(spark, SF), dc.OP5_SQL)
    df = docs(spark, [(1, TEXT), (1, "clean"), (None, TEXT), (None, "fine"), (3, TEXT), (3, TEXT)])
    assert dc.drop_leaks(df, spark.createDataFrame([(1, TEXT)], ITEM)).count() == 2
