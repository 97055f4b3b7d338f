import hashlib
import math

import xxhash
from pyspark.sql import functions as F

from docloom.llm import fingerprints as fp
from tests.llm.helpers import SF, docs

M = (1 << 64) - 1


def chained(seed, *parts):
    """Spark's hash of several columns: each one's hash is the seed of the next."""
    h = seed
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), h)
    return h


def long_hash(seed, n, text):
    h = xxhash.xxh64_intdigest((n & 0xFFFFFFFF).to_bytes(4, "little"), seed)
    return xxhash.xxh64_intdigest(text.encode(), h)


def brute(text):
    text = text or ""
    lines = text.split("\n") if text else []
    exact, counts, triples = [0] * 16, [0] * 64, 0
    for line in lines:
        for s in range(8):
            h = long_hash(42, s, line)
            exact[2 * s] = (exact[2 * s] + (h & 0xFFFFFFFF)) % (1 << 32)
            exact[2 * s + 1] = (exact[2 * s + 1] + (h >> 32)) % (1 << 32)
        ws = [w for w in line.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
        for tri in [ws[i : i + 3] for i in range(len(ws) - 2)] or ([ws] if ws else []):
            h = chained(42, *tri)
            triples += 1
            for b in range(64):
                counts[b] += h >> b & 1
    return exact, counts, triples


def text_of(exact, counts):
    packed = [x for k in range(32) for x in (counts[k], counts[k + 32])]
    return "".join(f"{x:08x}" for x in exact + packed)


def cosine(a, b):
    if a[:2] == b[:2]:
        return 1.0
    x, y = ([c - n / 2 for c in cs] for _, cs, n in (a, b))
    xx, yy = sum(v * v for v in x), sum(v * v for v in y)
    return min(1.0, max(0.0, sum(p * q for p, q in zip(x, y, strict=True)) / math.sqrt(xx) / math.sqrt(yy))) if xx and yy else 0.0


def check(rows, result):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = brute(t), brute(edited), brute(nxt)
        want.setdefault(d, []).append(
            (len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(*a[:2]), text_of(*b[:2]), round(cosine(a, b), 9), round(cosine(a, c), 9))
        )
    got = {}
    for r in result.collect():
        got.setdefault(r["doc_id"], []).append(
            (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9))
        )
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def result_over(spark, rows, tmp_path):
    docs(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return fp.op6_document_fingerprint(spark, str(tmp_path))


def test_whole_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, fp.op6_document_fingerprint(spark, SF))


def test_nulls_ties_repeats_and_gaps(spark, tmp_path):
    check([(5, None), (5, "a\nb"), (5, "a\nb"), (None, "x y z w"), (None, ""), (-7, "é\nü ö ä"), (10**12, "q " * 3000), (1, "a b c\n\nd")], result_over(spark, rows := [(5, None), (5, "a\nb"), (5, "a\nb"), (None, "x y z w"), (None, ""), (-7, "é\nü ö ä"), (10**12, "q " * 3000), (1, "a b c\n\nd")], tmp_path))
    assert rows


def test_one_row_and_none(spark, tmp_path):
    check([(1, "abcdef ghi")], result_over(spark, [(1, "abcdef ghi")], tmp_path / "one"))
    assert result_over(spark, [], tmp_path / "none").count() == 0
    check([(None, "a"), (None, "b")], result_over(spark, [(None, "a"), (None, "b")], tmp_path / "null"))


def test_ranges_don_t_show(spark, monkeypatch):
    rows = [(i * i, f"t{i}") for i in range(60)]
    df = docs(spark, rows)
    for ranges in (1, 2, 7, 500):
        got = {r["doc_id"]: r["next"]["text"] for r in fp.with_next(df, "doc_id", "text", ranges=ranges).collect()}
        assert got == {i * i: f"t{(i - 1) % 60}" for i in range(60)}


def test_homomorphism_and_order(spark):
    a, b = "one two three\nfour five six", "seven\neight nine ten eleven"
    row = docs(spark, [(1, a)]).select(
        *(fp.fingerprint_columns(F.lit(t)).alias(n) for n, t in (("a", a), ("b", b), ("ab", a + "\n" + b), ("ba", b + "\n" + a)))
    )
    c = row.select(
        (fp.fingerprint_text(fp.combine(F.col("a"), F.col("b"))) == fp.fingerprint_text(F.col("ab"))).alias("sum"),
        (fp.fingerprint_text(F.col("ab")) == fp.fingerprint_text(F.col("ba"))).alias("order"),
        (fp.fingerprint_text(fp.combine(F.col("ab"), F.col("b"), -1)) == fp.fingerprint_text(F.col("a"))).alias("removed"),
        (fp.fingerprint_text(F.col("a")) != fp.fingerprint_text(F.col("b"))).alias("differ"),
    ).first()
    assert all(c)


def test_clashing_columns(spark):
    df = docs(spark, [(1, "a b c")]).withColumnRenamed("lang", "fp").withColumnRenamed("source", "fingerprint")
    r = fp.fingerprint_documents(df).first()
    assert r["fingerprint"] == text_of(*brute("a b c")[:2])


def test_ids_at_the_ends_and_in_clusters(spark, tmp_path):
    ends = [(-(2**63), "a b"), (2**63 - 1, "c d"), (0, "e f"), (2**62, "g"), (2**62 + 1, "h i"), (2**62 + 2, "j")]
    check(ends, result_over(spark, ends, tmp_path / "ends"))
    dense = [(i, f"t{i}") for i in range(2000)] + [(2**60, "far")]
    out = fp.with_next(docs(spark, dense), "doc_id", "text", ranges=16)
    got = {r["doc_id"]: r["next"]["text"] for r in out.collect()}
    assert got == {0: "far", 2**60: "t1999", **{i: f"t{i - 1}" for i in range(1, 2000)}}


def test_ranges_hold_like_numbers_of_rows(spark):
    df = docs(spark, [(i, "t") for i in range(2000)] + [(2**60, "far")])
    sizes = []
    for ranges in (4, 16):
        placed = fp.place_rows(df.select(F.col("doc_id").alias("k")), "k", ranges)[0]
        sizes.append(max(r["count"] for r in placed.groupBy("r").count().collect()))
    assert sizes[0] < 700 and sizes[1] < 250


def test_taking_away_what_was_never_there_can_be_undone(spark):
    a, b = "one two three", "x " * 5000 + "\n" + "y z " * 3000
    row = docs(spark, [(1, a)]).select(*(fp.fingerprint_columns(F.lit(t)).alias(n) for n, t in (("a", a), ("b", b))))
    less = row.withColumn("less", fp.combine(F.col("a"), F.col("b"), -1))
    c = less.select((fp.fingerprint_text(fp.combine(F.col("less"), F.col("b"))) == fp.fingerprint_text(F.col("a"))).alias("same")).first()
    assert c["same"]
