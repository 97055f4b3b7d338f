"""SimHash near-duplicates, linked with anchor points of a covering code.

Distinct 64-bit fingerprints at three or fewer differing bits differ in at most
one bit of their lower or their upper half. On 31 bits of each half the
codewords of the Hamming(31, 26) code are the anchors: the code is perfect with
covering radius 1, so every fingerprint has one home anchor within that radius,
and a fingerprint at distance 1 lies within radius plus threshold = 2 of it. So
each fingerprint is copied to its 16 anchors within distance 2 per half, and at
each anchor the ones at home are compared with all copies. The lost bit of each
half only adds candidates; every pair is compared on all 64 bits.

Copies of one fingerprint are counted once, before this, and at an anchor a
spanning set of links is kept, never all pairs of a group. The groups are the
connected components of the links.

That is for texts that are all but equal. For a Jaccard similarity of shingles
(``similarity``), wider fingerprints meet at the anchors of :mod:`docloom.llm.wide`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import wide
from docloom.llm.arrow import add_columns
from docloom.operators.components import connected_components
from docloom.plans.tables import materialize, sized

SHINGLE, SEED, MAX_BITS = 3, 42, 3
BITS = 31
#: Groups at one anchor up to this size are compared pair by pair, larger ones searched for a spanning set.
SMALL, SPLIT = 24, 8192


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of the word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    total = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for i in range(0, total, 1 << 16):
        part = zip(starts[i : min(total, i + (1 << 16))], ends[i + SHINGLE - 1 :], strict=False)
        hashes = np.array([digest(line[s:e], SEED) for s, e in part], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def add_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as a signed long. Null texts count as empty (0)."""
    kind = {out: (T.LongType(), pa.int64())}
    return add_columns(docs, [text], kind, lambda ts: [[f - (1 << 64) if (f := fingerprint(t)) >> 63 else f for t in ts]])


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Tables for the lower 16 and the upper 15 of 31 bits; bit p counts as p + 1."""
    low = np.zeros(1 << 16, np.uint8)
    high = np.zeros(1 << 15, np.uint8)
    for p in range(BITS):
        table, bit = (low, p) if p < 16 else (high, p - 16)
        table ^= np.where(np.arange(len(table)) >> bit & 1, p + 1, 0).astype(np.uint8)
    return low, high


LOW, HIGH = _syndromes()


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into ``fps``, at home) for all anchors within distance 2 per half."""
    out_anchor, out_index, out_home = [], [], []
    index = np.arange(len(fps), dtype=np.int64)
    one = np.uint64(1)
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)) & np.uint64((1 << BITS) - 1)
        s = LOW[x & np.uint64(0xFFFF)] ^ HIGH[x >> np.uint64(16)]
        tag = np.uint64(half << 40)
        off = s > 0
        home = np.where(off, x ^ (one << (np.maximum(s, 1) - 1).astype(np.uint64)), x)
        out_anchor.append(home | tag)
        out_index.append(index)
        out_home.append(np.ones(len(fps), bool))
        # Two bits whose positions add up to the syndrome lead to a codeword at distance 2.
        for j in range(1, BITS + 1):
            k = s ^ np.uint8(j)
            at = np.flatnonzero(off & (k > j))
            flip = (one << np.uint64(j - 1)) | (one << (k[at] - 1).astype(np.uint64))
            out_anchor.append(x[at] ^ flip | tag)
            out_index.append(at)
            out_home.append(np.zeros(len(at), bool))
    return np.concatenate(out_anchor), np.concatenate(out_index), np.concatenate(out_home)


def near(a: np.ndarray, b: np.ndarray, bits: int = MAX_BITS) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def spanning_links(fps: np.ndarray, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what all links among distinct ``fps`` connect.

    Breadth-first from a seed: each value is compared with those not yet
    reached, so at most one link per value comes out. Groups over ``SPLIT`` are
    first cut by each 16-bit block, one of which is equal in any linked pair.
    """
    if len(fps) > SPLIT and depth < 4:
        for block in range(4):
            part = (fps >> np.uint64(16 * block)) & np.uint64(0xFFFF)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for group in np.split(order, cuts):
                if len(group) > 1:
                    # A group that doesn't get smaller is searched as it is.
                    yield from spanning_links(fps[group], depth + 1 if len(group) < len(fps) else 4)
        return
    left = np.sort(fps)
    while len(left) > 1:
        seeds, left = [left[0]], left[1:]
        while seeds and len(left):
            x = seeds.pop()
            hit = near(left, x)
            if hit.any():
                found = left[hit]
                yield np.full(len(found), x), found
                seeds += list(found)
                left = left[~hit]


def _links_at_anchors(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows in order of anchor; groups are whole."""
    n = len(anchor)
    cuts = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
    homes = np.add.reduceat(home.astype(np.int64), begin)
    size = end - begin
    for g in np.flatnonzero((size > SMALL) & (homes > 0)):
        yield from spanning_links(np.unique(fp[begin[g] : end[g]]))
    small = np.repeat((size <= SMALL) & (homes > 0), size)
    anchor, fp, home = anchor[small], fp[small], home[small]
    k, at = 1, np.arange(max(0, len(anchor) - 1))
    while len(at):
        at = at[at + k < len(anchor)]
        at = at[anchor[at] == anchor[at + k]]
        hit = at[(home[at] | home[at + k]) & near(fp[at], fp[at + k])]
        if len(hit):
            yield fp[hit], fp[hit + k]
        k += 1


COPY = "anchor long, fp long, home boolean"
LINK = "a long, b long"


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(fps), 1 << 14):
            anchor, index, home = anchors(fps[i : i + (1 << 14)])
            part = fps[i : i + (1 << 14)][index]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(part.view(np.int64)), pa.array(home)], ["anchor", "fp", "home"]
            )


def _by_anchor(links_of):
    """Batches in order of anchor, to links: an anchor whose rows go on in the next batch waits.

    ``links_of`` gets the columns of whole anchors; all rows of one anchor are
    held at a time.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for a, b in links_of(*(np.concatenate(c) for c in zip(*parts, strict=True))):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last or (held and held[-1][0][-1] != rows[0][0]):
                held.append([r[:last] for r in rows])
                yield from emit(held)
                held = []
            held.append([r[last:] for r in rows])
        if held:
            yield from emit(held)

    return link


def _close_links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in _links_at_anchors(anchor, fp.view(np.uint64), home):
        yield a.view(np.int64), b.view(np.int64)


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints at up to three bits."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = distinct.mapInArrow(_replicate, COPY)
    met = copies.repartition(parts, "anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(_by_anchor(_close_links), LINK)


def _row_key(docs: DataFrame) -> Column:
    """A hash of all columns, nulls told apart."""
    return F.xxhash64(*(x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))))


def _labelled(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, doc_key, fingerprint), and (fingerprint, label) of each distinct one."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), _row_key(docs).alias("doc_key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = materialize(add_fingerprints(rows, "t").drop("t"), "simhash")
    classes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    classes = materialize(classes, "classes")
    parts = connected_components(link_fingerprints(classes.select("fingerprint")), "a", "b")
    parts = parts.withColumnsRenamed({"node": "fingerprint"})
    labelled = classes.join(parts, "fingerprint", "left").withColumn("label", F.coalesce("component", "fingerprint"))
    return rows, materialize(labelled.select("fingerprint", "least", "label"), "labels")


WORDS = [f"f{k}" for k in range(wide.WIDE // 64)]


def link_similar(classes: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) among rows (node, f0.., anchors) whose wide fingerprints differ in up to ``bits`` bits."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = classes.select(F.explode("anchors").alias("anchor"), "node", *WORDS)

    def links(anchor: np.ndarray, node: np.ndarray, *words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fps = np.ascontiguousarray(np.stack(words, axis=1)).view(np.uint64)
        return wide.links_at_anchors(anchor, node, fps, bits)

    return copies.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_by_anchor(links), LINK)


def _alike(docs: DataFrame, doc_id: str, text: str, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, doc_key, words), and (words, label) of each distinct sequence of words."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), _row_key(docs).alias("doc_key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    long, many = (T.LongType(), pa.int64()), (T.ArrayType(T.LongType()), pa.list_(pa.int64()))
    added = {"words": (T.BinaryType(), pa.binary()), **dict.fromkeys(WORDS, long), "anchors": many}

    def fingerprints(texts: list) -> list[list]:
        out: list[list] = [[] for _ in added]
        # A few texts at a time: the counts behind the bits take much more room than the bits.
        for i in range(0, len(texts), 256):
            found = [wide.counts(t, shingle) for t in texts[i : i + 256]]
            ones = np.stack([c for _, c in found])
            for column, values in zip(out, [[w for w, _ in found], *wide.bits_of(ones).view(np.int64).T, wide.anchors(ones)], strict=True):
                column.extend(values)
        return out

    rows = materialize(add_columns(rows, ["t"], added, fingerprints).drop("t"), "simhash")
    first = F.first(F.struct(*WORDS, "anchors")).alias("x")
    classes = rows.groupBy("words").agg(first).select("words", F.monotonically_increasing_id().alias("node"), "x.*")
    classes = materialize(classes, "classes")
    parts = connected_components(link_similar(classes, wide.bits_at(similarity)), "a", "b")
    labelled = classes.select("words", "node").join(parts, "node", "left").select("words", F.coalesce("component", "node").alias("label"))
    return rows, materialize(labelled, "labels")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints are signed longs. ``component_id`` is the smallest id that is
    reachable over links of up to three bits, the row's own included; nulls
    count only where a whole group has no id (then it is null). Null and
    wordless texts have fingerprint 0 and link like others. Repeated rows all
    stay. Other columns are dropped.
    """
    rows, labels = _labelled(docs, doc_id, text)
    least = labels.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labels.join(least, "label").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float | None = None, shingle: int = 5
) -> DataFrame:
    """One row of each group, with all its columns.

    Without ``similarity`` the groups are those of :func:`simhash_groups`. With
    it, texts link whose wide fingerprints differ in no more bits than those of
    texts at this Jaccard similarity of ``shingle``-word shingles do on average,
    and one standard deviation more: about 0.035 of similarity at 0.8, so texts
    somewhat below it may link, too.
    Texts of equal words (A-Z in either case) always link, so all wordless texts
    are one group.

    The row with the smallest id stays; rows without an id come last. Of rows of
    one id the one with the smallest hash of all its columns stays, so only
    rows that are equal in everything tie, and of these one is left. Columns
    must be of types that have a hash. An empty table gives an empty one.
    """
    if similarity is None:
        rows, labels = _labelled(docs, doc_id, text)
        rows = rows.join(labels.select("fingerprint", "label"), "fingerprint")
    else:
        rows, labels = _alike(docs, doc_id, text, similarity, shingle)
        rows = rows.select("doc_id", "doc_key", "words").join(labels, "words")
    rows = materialize(rows.select("doc_id", "doc_key", "label"), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc_key")
    first = rows.groupBy("label").agg(F.min(rank).alias("r")).select("label", "r.doc_id", "r.doc_key")
    first = first.withColumnsRenamed({"label": "f_label", "doc_id": "f_id", "doc_key": "f_key"})
    same = (F.col("label") == F.col("f_label")) & F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("doc_key") == F.col("f_key"))
    # Keys of rows that go, and of kept rows that repeat: texts move only where these outgrow a broadcast.
    gone = sized(materialize(rows.join(first, same, "left_anti").select("doc_id", "doc_key").distinct(), "gone"))
    twice = rows.join(first, same, "left_semi").groupBy("doc_id", "doc_key").count().where("count > 1").select("doc_id", "doc_key")
    twice = sized(materialize(twice, "twice"))

    def among(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("__id"), F.col("doc_key").alias("__k"))
        return df.join(keys, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), how)

    kept = among(docs.withColumn("__key", _row_key(docs)), gone, "left_anti")
    if twice.limit(1).count():
        once = among(kept, twice, "left_semi").dropDuplicates([doc_id, "__key"])
        kept = among(kept, twice, "left_anti").unionByName(once)
    return kept.drop("__key")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = simhash_groups(docs.select("doc_id", "text"))
    return groups.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))
