"""Substring dedup: every repeated window of words is removed.

Every window of ``WINDOW`` words gets a Rabin-Karp hash (of XXH64 word hashes,
modulo 2^64). Tasks cut their rows into batches and send the distinct hashes of
each batch's windows, with the places where they start, to the bucket that a
second hash, on another base, names: arrays on the way, so that a window costs
about ten bytes of shuffle, and rows again behind it. There Spark counts them:
a hash that stands in a bucket more than once was sent by more than one batch.
Those, and the ones that a batch saw twice itself, are repeated. Their places go
back to their batch, overlapping windows merge to maximal intervals of words,
and one join brings each document its intervals; texts are shuffled for it only
where the intervals outgrow a broadcast.

A window that repeats a million times costs a row for each batch that has it,
not for each time. Buckets are as many as the data's size asks for, and Spark
sorts and spills them, so no task or worker holds more of them than it can.

All 64 bits of the hash are compared, and by the bucket log2(buckets) bits of
the second one. The words aren't: some N^2 / (2^65 * buckets) pairs of N
different windows are expected to meet, 0.002 at 4 * 10^9 windows (30 GB) and
200 buckets. Buckets grow with N, so this grows with N, not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.arrow import add_columns, slices
from docloom.plans.tables import materialize, sized

WINDOW = 35
#: Bytes of text for each task that counts; places in a row of the shuffle lie within one block of words.
TASK_BYTES, BLOCK_WORDS = 64 << 20, 1 << 15
#: Words that a batch gathers before it is sent (one document may exceed it).
BATCH_WORDS = 1 << 19
#: Word hashes kept in a worker's cache.
CACHE = 200_000
BASE = 0x9E3779B97F4A7C15
#: Base of the hash that names the bucket.
SECOND = 0xC2B2AE3D27D4EB4F

PART = "bucket int, batch long, base int, hashes array<bigint>, places array<smallint>, documents binary"
PART_FIELDS = pa.schema(
    [
        ("bucket", pa.int32()),
        ("batch", pa.int64()),
        ("base", pa.int32()),
        ("hashes", pa.list_(pa.int64())),
        ("places", pa.list_(pa.int16())),
        ("documents", pa.binary()),
    ]
)


class WordHashes(dict):
    """XXH64 by word; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class _Powers:
    """Powers of a base and of its inverse, as far as they were needed."""

    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def get(cls, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls.known or len(cls.known[base][0]) < n:
            size = 1 << n.bit_length()

            def series(x: int) -> np.ndarray:
                return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)]))

            cls.known[base] = series(base), series(pow(base, -1, 1 << 64))
        up, down = cls.known[base]
        return up[:n], down[:n]


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than the six ASCII blanks."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def window_hashes(words: np.ndarray, window: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hash of each window of the word hashes, mixed at the end."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64)
    up, down = _Powers.get(n, base)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * down, dtype=np.uint64)])
    h = (sums[window:] - sums[:-window]) * up[: n - window + 1]
    # The low bits of a product modulo 2^64 see only low bits: fold the high ones in.
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def pack_gaps(places: np.ndarray) -> bytes:
    """Increasing numbers as gaps: a byte each, 255 for another 255 to come."""
    gaps = np.diff(places, prepend=0)
    extra = gaps // 255
    out = np.full(len(gaps) + int(extra.sum()), 255, np.uint8)
    out[np.cumsum(extra + 1) - 1] = gaps % 255
    return out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw < 255]


def _row_key(doc_id: int | None, text: str | None) -> tuple[int | None, int]:
    return doc_id, xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 42)


def _send(window: int, buckets: int):
    """Batches of rows (doc_id, text) to hashes by bucket and a table of the batch's documents."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, cache = TaskContext.get().partitionId(), WordHashes()
        number, docs, hashes, sizes, held = 0, [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, docs, hashes, sizes, held
            batch = (task << 32) | number
            number += 1
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            h = np.concatenate([window_hashes(x, window) for x in hashes])
            counts = np.maximum(np.array(sizes, np.int64) - window + 1, 0)
            place = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(h))
            order = np.argsort(h, kind="stable")
            s = h[order]
            first = np.ones(len(s), bool)
            first[1:] = s[1:] != s[:-1]
            twice = ~first
            twice[:-1] |= ~first[1:]
            own = np.sort(place[order[twice]])
            keep = np.sort(order[first])
            h, place = h[keep], place[keep]
            second = np.concatenate([window_hashes(x, window, SECOND) for x in hashes])[keep]
            bucket = (second >> np.uint64(32)) % np.uint64(buckets)
            del second
            # Rows of one bucket and block of words, whose places are offsets within the block.
            group = (place // BLOCK_WORDS) * buckets + bucket.astype(np.int64)
            order = np.argsort(group, kind="stable")
            h, place, group = h[order].view(np.int64), place[order], group[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]).astype(np.int32) if len(group) else np.zeros(1, np.int32)
            head = group[cuts[:-1]]
            base = (head // buckets * BLOCK_WORDS).astype(np.int32)
            for i in range(0, len(head), 1 << 10):
                part = cuts[i : i + (1 << 10) + 1]
                n, low, high = len(part) - 1, part[0], part[-1]
                offsets = pa.array(part - low)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((head[i : i + n] % buckets).astype(np.int32)),
                        pa.array(np.full(n, batch, np.int64)),
                        pa.array(base[i : i + n]),
                        pa.ListArray.from_arrays(offsets, pa.array(h[low:high])),
                        pa.ListArray.from_arrays(offsets, pa.array((place[low:high] % BLOCK_WORDS).astype(np.int16))),
                        pa.nulls(n, pa.binary()),
                    ],
                    schema=PART_FIELDS,
                )
            # Not to be counted: the batch's own repeats, its documents and their places.
            ids = pa.array([d[0] for d in docs], pa.int64())
            table = pa.table({"doc_id": ids, "key": pa.array([d[1] for d in docs], pa.uint64()), "start": starts[:-1], "words": sizes})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            held_back = _framed(pack_gaps(own)) + _framed(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_pylist([{"bucket": batch % buckets, "batch": batch, "documents": held_back}], PART_FIELDS)
            docs, hashes, sizes, held = [], [], [], 0

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if len(words) < window:
                    continue
                docs.append(_row_key(doc_id, text))
                hashes.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
                sizes.append(len(words))
                held += len(words)
                if held >= BATCH_WORDS:
                    yield from flush()
        if docs:
            yield from flush()

    return send


def _framed(data: bytes) -> bytes:
    return len(data).to_bytes(8) + data


def _unframe(data: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(data[:8])
    return data[8 : 8 + n], data[16 + n :]


def _intervals(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal [start, end) intervals of words under windows at ``starts`` (increasing)."""
    cut = np.flatnonzero(np.diff(starts) > window)
    begin = starts[np.concatenate([[0], cut + 1])]
    end = starts[np.concatenate([cut, [len(starts) - 1]])] + window
    return np.stack([begin, end], axis=1)


SPANS = "doc_id long, key long, spans binary"


def _answer(window: int):
    """Rows in order of batch, its documents first, then places: intervals by document."""

    def one(own_and_table: bytes, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        own, table = _unframe(own_and_table)
        docs = pa.ipc.open_stream(table).read_all()
        starts, words = docs["start"].to_numpy(), docs["words"].to_numpy()
        marked = np.zeros(int(starts[-1] + words[-1]), bool)
        for places in [unpack_gaps(own), *found]:
            marked[places] = True
        places = np.flatnonzero(marked)
        if not len(places):
            return
        doc = np.searchsorted(starts, places, side="right") - 1
        ids, keys = docs["doc_id"].to_pylist(), docs["key"].to_numpy().view(np.int64)
        out = []
        for group in np.split(np.arange(len(places)), np.flatnonzero(np.diff(doc)) + 1):
            d = doc[group[0]]
            spans = _intervals(places[group] - starts[d], window)
            out.append((ids[d], int(keys[d]), spans.astype("<i4").tobytes()))
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "key", "spans"]
        )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, documents, found = None, None, []
        for got in batches:
            batch = got.column(0).to_numpy()
            ends = np.concatenate([np.flatnonzero(np.diff(batch)) + 1, [len(batch)]]) if len(batch) else []
            begin = 0
            for end in ends:
                if batch[begin] != now:
                    if documents is not None:
                        yield from one(documents, found)
                    now, documents, found = batch[begin], None, []
                if documents is None:
                    documents, begin = got.column(2)[int(begin)].as_py(), begin + 1
                found.append(got.column(1)[int(begin) : int(end)].to_numpy(zero_copy_only=False).astype(np.int64))
                begin = end
        if documents is not None:
            yield from one(documents, found)

    return answer


def repeated_spans(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """(doc_id, key, spans) of rows (doc_id, text) with repeated windows.

    ``key`` is the XXH64 of the text; rows of one id and text give equal spans.
    ``spans`` packs [start, end) word numbers as little-endian int pairs.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    buckets = buckets or 4 * parts
    sent = docs.mapInArrow(_send(window, buckets), PART).repartition(parts, "bucket")
    back = seen_again(sent).repartition(parts, "batch").sortWithinPartitions("batch", F.asc_nulls_first("place"))
    return back.mapInArrow(_answer(window), SPANS)


def seen_again(sent: DataFrame) -> DataFrame:
    """(batch, place, documents) of rows ``PART``: places whose hash a bucket has more than once, and batches' documents.

    A shuffle by bucket that went before serves: rows are sorted and counted where they are.
    """
    pairs = F.arrays_zip("hashes", "places")
    rows = sent.select("bucket", "batch", "base", "documents", F.inline_outer(pairs))
    rows = rows.select("bucket", "batch", F.col("hashes").alias("h"), (F.col("base") + F.col("places")).alias("place"), "documents")
    again = rows.withColumn("n", F.count("*").over(Window.partitionBy("h", "bucket"))).where("n > 1 OR documents IS NOT NULL")
    return again.select("batch", "place", "documents")


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """(doc_id, text, spans): every row with its intervals of repeated words, null if it has none.

    A window of ``window`` words is repeated if the same words also start
    anywhere else, in the same text too. Words are runs without the six ASCII
    blanks, unchanged. Null texts count as empty; texts shorter than a window
    have no intervals. Rows may repeat (their windows then do, too), ids may be
    null. Other columns are dropped.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Written first and counted, so that the texts needn't move to a short list.
    spans = sized(materialize(repeated_spans(rows, window, **options).distinct(), "spans").withColumnsRenamed({"doc_id": "s_id", "key": "s_key"}))
    same = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.xxhash64("text") == F.col("s_key"))
    return rows.join(spans, same, "left").select("doc_id", "text", "spans")


def cut_words(text: str | None, spans: bytes | None) -> tuple[int, int, bytes]:
    """(number of words, number removed, the kept ones joined by one space)."""
    words = words_of(text)
    if not spans:
        return len(words), 0, b" ".join(words)
    kept, at, removed = [], 0, 0
    for begin, end in np.frombuffer(spans, "<i4").reshape(-1, 2).tolist():
        kept += words[at:begin]
        removed += end - begin
        at = end
    return len(words), removed, b" ".join(kept + words[at:])


def remove_repeats(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the texts that :func:`find_repeats` leaves."""
    added = {"n_words": (T.LongType(), pa.int64()), "n_removed": (T.LongType(), pa.int64()), "kept": (T.StringType(), pa.string())}

    def cut(texts: list, spans: list) -> list[list]:
        rows = [cut_words(t, s) for t, s in zip(texts, spans, strict=True)]
        return [[r[0] for r in rows], [r[1] for r in rows], [r[2].decode("utf-8", "surrogatepass") for r in rows]]

    return add_columns(found, ["text", "spans"], added, cut).select("doc_id", *added)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of what is left of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = remove_repeats(find_repeats(docs.select("doc_id", "text")))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT row_no, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
), starts AS (
  SELECT row_no, i AS pos, md5(array_to_string(w[i:i + 34], ' ')) AS k
  FROM (SELECT row_no, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), again AS (
  SELECT row_no, pos FROM starts WHERE k IN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1)
), marked AS (
  SELECT words.row_no, words.pos, words.word,
    max(again.pos) OVER (PARTITION BY words.row_no ORDER BY words.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN again ON words.row_no = again.row_no AND words.pos = again.pos
), kept AS (
  SELECT row_no, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM marked GROUP BY row_no
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row_no)
"""
