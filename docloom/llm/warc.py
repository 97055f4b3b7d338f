"""WARC archives compressed record by record with an embedded dictionary.

Each archive trains a Zstandard dictionary from its own records, stores it in a
leading skippable frame (magic 0x184D2A5D) and compresses every record as a
frame of its own with that dictionary, so a record can be read alone.

Archives are written by tasks, each under a bounded size, under names that no
other attempt uses, and Spark commits their names as a table, the manifest, in
which only attempts that succeeded have rows. Readers open what the manifest
lists, so a task that runs again, in whatever order its rows then come, leaves
at most files that nobody reads. Records whose payload another record holds
become revisits; which one holds it is decided on digests alone, and payloads
are shuffled once, by page.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.arrow import slices
from docloom.plans.tables import discard_at_exit, new_path

#: Uncompressed bytes after which an archive is closed; of these at most ``SAMPLE_BYTES`` train the dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES = 16 << 20, 2 << 20, 64 << 10
LEVEL = 3
DICT_MAGIC = (0x184D2A5D).to_bytes(4, "little")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Hadoop-style path, and the path on it."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _uri(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(uri: str | None) -> int | None:
    found = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found not in ("", "null") else None


def record(page: int | None, url: str | None, digest: str, payload: bytes | None, size: int, refers: int | None) -> bytes:
    """One WARC record; ``payload`` None makes it a revisit of ``refers``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_uri(page)}"]
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe=";/?:@&=+$,#!*'()[]~%"))
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from evenly spaced records; empty if there is too little to learn from."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    # A record over the bound would fill the sample alone: 64 KiB of it are enough for a dictionary of that size.
    sample = [r[: 64 << 10] for r in records[::step]]
    if len(sample) < 8 or sum(map(len, sample)) < 4 * 1024:
        return b""
    try:
        size = min(DICT_BYTES, max(1024, sum(map(len, sample)) // 16))
        return zstandard.train_dictionary(size, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack_archive(records: list[bytes]) -> bytes:
    trained = train_dictionary(records)
    out = [DICT_MAGIC, len(trained).to_bytes(4, "little"), trained]
    known = zstandard.ZstdCompressionDict(trained) if trained else None
    if known:
        known.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def unpack_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    known = None
    if data[:4] == DICT_MAGIC:
        size = int.from_bytes(data[4:8], "little")
        known = zstandard.ZstdCompressionDict(data[8 : 8 + size]) if size else None
        data = memoryview(data)[8 + size :]
    opened = zstandard.ZstdDecompressor(dict_data=known).stream_reader(data, read_across_frames=True)
    stream = io.BufferedReader(opened, 1 << 20)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not at the start of a WARC record")
        headers = {}
        while (line := stream.readline().strip()):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record doesn't end where its length says")
        yield headers, block


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        number, records, held = 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, records, held
            name = f"part-{task.partitionId():06d}-{number:05d}-{uuid.uuid4().hex}.warc.zst"
            data = pack_archive(records)
            # The name's ending must not make the stream compress the archive once more.
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            row = pa.RecordBatch.from_pydict({"name": [name], "records": [len(records)], "bytes": [len(data)]}, WRITTEN)
            number, records, held = number + 1, [], 0
            return row

        for batch in slices(batches, 64):
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for page, url, digest, payload, size, refers in zip(*columns, strict=True):
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                records.append(record(page, url, name, payload, size, refers))
                held += len(records[-1])
                if held >= ARCHIVE_BYTES:
                    yield flush()
        if records:
            yield flush()

    return write


WRITTEN = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
#: Folder of the manifest within that of the archives.
MANIFEST = "_manifest"


def write_warc(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0
) -> tuple[int, int, int]:
    """Write a record per row to ``folder``; returns (archives, records, bytes).

    The payload is the html in UTF-8, null counts as empty. Of records with
    equal payloads of at least ``min_bytes`` bytes, the one with the largest id
    is a response and the others revisit it. Rows that tie for the largest id
    (repeated rows) are all responses, as are rows of payloads that have no id
    at all. Other columns are dropped; an empty table writes no archive. The
    folder's manifest is replaced: archives that another call wrote there are
    no longer read.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    narrow = rows.select("page_id", "digest", "size")
    largest = narrow.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"))
    # Digests meet their group on narrow rows; a payload half of all rows share is split by AQE here, not with its bytes.
    role = narrow.join(largest, "digest", "left").select(
        F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "top"
    ).where("top IS NOT NULL AND NOT (r_id <=> top)").distinct()
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    out = rows.join(role, same, "left").select(
        "page_id", "url", "digest", F.when(F.col("r_digest").isNull(), F.col("payload")).alias("payload"), "size", "top"
    )
    done = out.mapInArrow(_write(folder), "name string, records long, bytes long")
    done.write.mode("overwrite").parquet(f"{folder}/{MANIFEST}")
    listed = manifest(pages.sparkSession, folder)
    got = listed.agg(F.count("*"), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return tuple(got)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, records, bytes) of the archives that :func:`write_warc` finished in ``folder``; none if it never ran."""
    fs, root = file_system(folder)
    schema = "name string, records long, bytes long"
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{MANIFEST}")


RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("warc_type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
PA_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("warc_type", pa.string()),
        ("url", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of all archives that the folder's manifest lists, one row each.

    A response's digest is computed anew from its payload and must be the one
    in its header. A revisit has no payload; its size and digest are those of
    the payload that it refers to. ``payload`` False leaves payloads out. A
    folder without a manifest has no records.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stored:
                    data = stored.read()
                rows, held = [], 0
                for headers, block in unpack_archive(data):
                    head, _, body = block.partition(b"\r\n\r\n")
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    kind = headers["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"{headers['warc-record-id']}: the payload isn't what its digest says")
                    sizes = [x for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")]
                    size = len(body) if kind == "response" else int(sizes[0].partition(b":")[2])
                    rows.append(
                        (
                            _page(headers["warc-record-id"]),
                            kind,
                            headers.get("warc-target-uri"),
                            digest,
                            size,
                            _page(headers.get("warc-refers-to")),
                            body if payload and kind == "response" else None,
                        )
                    )
                    held += len(block) if payload else 200
                    if held >= 8 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest(spark, folder).select("name").repartition(parts, "name").mapInArrow(read, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PA_RECORD, strict=True)], schema=PA_RECORD)


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = discard_at_exit(spark, new_path(spark, "warc"))
    write_warc(pages, folder)
    back = read_warc(spark, folder, payload=False)
    return back.select(
        "page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to"
    )


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT page_id, octet_length(b) AS n, h, max(page_id) OVER (PARTITION BY h) AS top FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((
      list_sum(list_transform(range(0, 5), lambda j:
        ((strpos('0123456789abcdef', substr(h, 1 + CAST((5 * i + j) // 4 AS INTEGER), 1)) - 1) >> CAST(3 - (5 * i + j) % 4 AS INTEGER)) % 2 * (1 << CAST(4 - j AS INTEGER))))
    ) AS INTEGER), 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m
"""
