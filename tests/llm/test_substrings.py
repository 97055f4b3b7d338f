import hashlib
import random
import re
from collections import Counter

import numpy as np

from docloom.llm import substrings as ss
from docloom.plans import tables
from tests.llm.helpers import SF, docs, same_as_oracle, tuples


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def run(spark, rows, window, **options):
    out = ss.remove_repeats(ss.find_repeats(docs(spark, rows), window=window, **options))
    return sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def test_whole_table_equals_sql(spark):
    same_as_oracle(ss.op8_substring_dedup(spark, SF), ss.OP8_SQL)


def test_small_texts_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 30)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "x " * 40), (None, "q w e r t y"), (None, "q w e r t y"), (7, rows[7][1]), (63, "é ü a\x0bb\tc\x1cd " * 2)]
    for window in (1, 2, 5, 9):
        assert run(spark, rows, window) == brute(rows, window)
    # Batches of few words, so that repeats are found between batches too.
    assert run(spark, rows, 4, buckets=3) == brute(rows, 4)


def test_batches_meet_in_buckets(monkeypatch):
    rng = np.random.default_rng(0)
    places = np.cumsum(rng.integers(1, 2000, 500))
    assert (ss.unpack_gaps(ss.pack_gaps(places)) == places).all()
    assert len(ss.unpack_gaps(ss.pack_gaps(places[:0]))) == 0
    assert (ss.unpack_gaps(ss.pack_gaps(np.array([0, 255, 510, 764]))) == [0, 255, 510, 764]).all()


def test_window_hashes_depend_on_content_only():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    both = np.concatenate([w, w[:100], w])
    h = ss.window_hashes(both, 35)
    assert (h[:466] == h[600:]).all() and len(set(h[:466].tolist())) == 466
    assert len(ss.window_hashes(w[:34], 35)) == 0


def test_long_text_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(120_000))
    df = docs(spark, [(1, text + " tail"), (2, text)]).withColumnRenamed("lang", "spans").withColumnRenamed("source", "s_id")
    out = ss.remove_repeats(ss.find_repeats(df))
    assert tuples(out, "doc_id", "n_words", "n_removed", "kept") == [(1, 120_001, 120_000, "tail"), (2, 120_000, 120_000, "")]


def test_empty(spark):
    assert ss.remove_repeats(ss.find_repeats(docs(spark, []))).count() == 0


def test_digest_of_nothing_kept(spark):
    rows = [(1, "a b " * 40)]
    out = ss.remove_repeats(ss.find_repeats(docs(spark, rows))).first()
    assert hashlib.sha256(out["kept"].encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_all_bits_of_both_hashes_are_compared(spark):
    """Hashes that nearly collide: one bit apart, or in other buckets."""
    one = 0x0123456789ABCDEF
    rows = [(0, 1, 0, [one, one ^ 1], [5, 6], None), (0, 2, 32768, [one], [7], None), (1, 3, 0, [one], [8], None)]
    rows += [(2, 10 + bit, 0, [one ^ (1 << bit)], [bit], None) for bit in range(63)] + [(2, 9, 0, [one], [99], None)]
    rows += [(3, 4, None, None, None, bytearray(b"x")), (3, 5, None, None, None, bytearray(b"y"))]
    got = ss.seen_again(spark.createDataFrame(rows, ss.PART)).collect()
    assert sorted((r["batch"], r["place"]) for r in got if r["place"] is not None) == [(1, 5), (2, 32775)]
    assert sorted(bytes(r["documents"]) for r in got if r["documents"]) == [b"x", b"y"]


def test_one_shuffle_of_windows_and_none_of_texts(spark):
    df = docs(spark, [(1, "a b c " * 30), (2, "a b c " * 30)]).select("doc_id", "text")
    plan = ss.seen_again(df.mapInArrow(ss._send(35, 8), ss.PART).repartition(8, "bucket"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_many_intervals_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    rows = [(i, "a b c d e f " * (i % 4)) for i in range(30)] + [(None, "a b c d e f " * 2)]
    assert run(spark, rows, 4) == brute(rows, 4)
