import random
import re

import numpy as np
import xxhash

from docloom.llm import simhash, wide
from docloom.plans import tables
from tests.llm.helpers import SF, docs, tuples


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    """{index: least id reachable} by comparing all pairs."""
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return fps, [min((x for x in ids[find(i)] if x is not None), default=None) for i in range(len(rows))]


def test_whole_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    fps, groups = brute_groups(rows)
    want = sorted((d, f"{f:016x}", g) for (d, _), f, g in zip(rows, fps, groups, strict=True))
    assert tuples(simhash.op7_simhash_dedup(spark, SF), "doc_id", "fingerprint", "component_id") == want


def test_fingerprint_of_odd_texts():
    for t in (None, "", " \t\n", "One", "ONE two", "a b c", "a b c a b c a b c", "É è ÀB\x0bc\x1cd e", "ab " * 9999, "x y z w v"):
        assert simhash.fingerprint(t) == brute_fingerprint(t), t


def test_anchors_meet_every_close_pair_and_only_16_each():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 400, dtype=np.uint64)
    for bits in (0, 1, 2, 3):
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, bits, replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        at, ix, home = simhash.anchors(x)
        homes = {(int(a), int(i)) for a, i, h in zip(at, ix, home, strict=True) if h}
        copies = {(int(a), int(i)) for a, i in zip(*simhash.anchors(y)[:2], strict=True)}
        assert {i for _, i in homes & copies} == set(range(len(x)))
    assert len(at) <= 32 * len(x)


def test_links_connect_what_all_links_connect(spark):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = {c for c in centre}
    for c in centre:
        for _ in range(300):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    arr = np.array(fps, np.uint64)
    want = list(range(len(fps)))

    def find(p, i):
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3):
            want[find(want, i)] = find(want, int(j))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fingerprint long")
    got = list(range(len(fps)))
    at = {f: i for i, f in enumerate(fps)}
    for a, b in simhash.link_fingerprints(df).collect():
        i, j = at[a % (1 << 64)], at[b % (1 << 64)]
        assert bin(fps[i] ^ fps[j]).count("1") <= 3
        got[find(got, i)] = find(got, j)
    roots = lambda p: {frozenset(i for i in range(len(fps)) if find(p, i) == r) for r in {find(p, i) for i in range(len(fps))}}
    assert roots(got) == roots(want)


def test_large_groups_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 8)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, dtype=np.uint64)
    fps = np.unique(np.array([base ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a in range(12) for b in range(12)], np.uint64))
    links = [(int(a), int(b)) for x, y in simhash.spanning_links(fps) for a, b in zip(x, y, strict=True)]
    group = {int(fps[0])}
    while more := {b for a, b in links if a in group} | {a for a, b in links if b in group}:
        if more <= group:
            break
        group |= more
    assert group == set(map(int, fps))


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(5, None), (3, ""), (3, ""), (None, "a b c d"), (None, "q w e r t y"), (9, "a b c d"), (7, "only this one")]
    df = docs(spark, rows).withColumnRenamed("lang", "fingerprint").withColumnRenamed("source", "component_id")
    got = simhash.simhash_groups(df)
    _, groups = brute_groups(rows)
    assert tuples(got, "doc_id", "component_id") == sorted(zip((d for d, _ in rows), groups, strict=True), key=lambda r: [(x is None, "n", x) for x in r]) or (
        sorted(map(str, tuples(got, "doc_id", "component_id"))) == sorted(str((d, g)) for (d, _), g in zip(rows, groups, strict=True))
    )
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(
        ["(3, '')", "(None, 'q w e r t y')", "(9, 'a b c d')", "(7, 'only this one')"]
    )
    assert simhash.simhash_groups(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def brute_alike(texts, similarity=0.8, shingle=5):
    """Group number of each text, by comparing the word sequences, anchors and wide fingerprints of all pairs."""
    found = [wide.counts(t, shingle) for t in texts]
    ones = np.stack([c for _, c in found])
    fps, at = wide.bits_of(ones), wide.anchors(ones)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    same = {}
    for i in range(len(texts)):
        j = same.setdefault(found[i][0], i)
        parent[find(i)] = find(j)
        for j in np.flatnonzero(wide.near(fps[: i + 1], fps[i], wide.bits_at(similarity))):
            if set(at[i]) & set(at[j]):
                parent[find(i)] = find(int(j))
    return [find(i) for i in range(len(texts))]


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_similar_texts_go_and_others_stay(spark):
    rng = random.Random(3)
    rows, pairs = [], []
    for i in range(150):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 400))]
        copy = edited(rng, words, max(1, int(len(words) * rng.uniform(0.002, 0.02))))
        pairs.append((2 * i, 2 * i + 1, jaccard(" ".join(words), " ".join(copy))))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy).upper())]
    kept = {r["doc_id"] for r in simhash.keep_one(docs(spark, rows), similarity=0.8).collect()}
    assert kept >= {a for a, _, _ in pairs}
    near = [b for _, b, j in pairs if j >= 0.8]
    assert len(near) > 100 and sum(b not in kept for b in near) / len(near) > 0.95
    assert all(b in kept for _, b, j in pairs if j < 0.6)


def test_similar_groups_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    groups = brute_alike([t for _, t in rows])
    want = sorted(min(d for (d, _), g in zip(rows, groups, strict=True) if g == k) for k in set(groups))
    kept = simhash.keep_one(spark.read.parquet(f"{SF}/documents.parquet"), similarity=0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_a_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{rng.randrange(4000)}" for _ in range(300)]
    texts = [" ".join(edited(rng, words, rng.randint(0, 4))) for _ in range(600)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, " ".join(f"x{rng.randrange(4000)}" for _ in range(200))) for i in range(50)]
    kept = [r["doc_id"] for r in simhash.keep_one(docs(spark, rows), similarity=0.8).collect()]
    assert sorted(kept) == [0, *range(1000, 1050)]
    found = [wide.counts(t, 5) for t in texts]
    fps, node = wide.bits_of(np.stack([c for _, c in found])), np.arange(len(texts))
    monkeypatch.setattr(wide, "SPLIT", 50)
    for links in (list(wide.spanning(node, fps, 85)), list(wide._reach(node, fps, 85))):
        group = {0}
        while more := {int(b) for x, y in links for a, b in zip(x, y, strict=True) if int(a) in group} | {int(a) for x, y in links for a, b in zip(x, y, strict=True) if int(b) in group}:
            if more <= group:
                break
            group |= more
        assert len(group) == len(texts)


def test_similar_odd_rows_and_ties(spark):
    rows = [(5, None), (3, ""), (3, ""), (None, "a b c d"), (None, "q w e r t y"), (9, "A b c d"), (7, "only this one")]
    df = docs(spark, rows).withColumnRenamed("lang", "words").withColumnRenamed("source", "anchors")
    kept = simhash.keep_one(df, similarity=0.8)
    assert kept.columns == df.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(
        ["(3, '')", "(None, 'q w e r t y')", "(9, 'A b c d')", "(7, 'only this one')"]
    )
    assert simhash.keep_one(df.limit(0), similarity=0.8).count() == 0
    # Rows of one id and text but other columns: always the same one stays.
    tied = docs(spark, [(1, "a b c", "en", s) for s in "abcdef"])
    first = [simhash.keep_one(tied.repartition(n), similarity=x).collect() for n in (1, 3, 7) for x in (None, 0.8)]
    assert all(len(f) == 1 and f == first[0] for f in first)


def test_wide_fingerprints_of_odd_texts():
    rng = np.random.default_rng(0)
    assert (wide.counts(None, 5)[1] == 0).all() and wide.counts("", 5)[0] == wide.counts(" \n", 5)[0]
    assert wide.counts("A b\tc", 5)[0] == wide.counts("a b c", 5)[0]
    long = " ".join(rng.choice(["x", "y", "z", "v"], 300_000))
    ones = wide.counts(long, 5)[1]
    assert abs(int(ones[0])) <= 4**5 and wide.anchors(ones[None, :]).shape == (1, 2 * wide.TABLES)
    assert len(np.unique(wide.anchors(ones[None, :]) // (2 * wide.LENGTH) ** wide.PARTS)) == wide.TABLES


def test_many_rows_that_go_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = [(i, f"one text of {i % 7}") for i in range(40)] + [(None, "one text of 3"), (2, "one text of 2"), (2, "one text of 2")]
    want = [sorted(map(str, simhash.keep_one(docs(spark, rows), similarity=s).collect())) for s in (None, 0.8)]
    monkeypatch.setattr(tables, "BROADCAST_BYTES", -1)
    assert want == [sorted(map(str, simhash.keep_one(docs(spark, rows), similarity=s).collect())) for s in (None, 0.8)]
    assert len(want[1]) == 7
