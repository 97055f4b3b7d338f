import base64
import glob
import hashlib
from collections import defaultdict

import zstandard

from docloom.llm import warc
from docloom.plans.tables import new_path
from tests.llm.helpers import SF, same_as_oracle

PAGE = "page_id long, url string, html string"


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def brute(rows, least=0):
    top = defaultdict(lambda: None)
    for p, _, t in rows:
        if p is not None and len((t or "").encode()) >= least:
            k = digest(t)
            top[k] = p if top[k] is None else max(p, top[k])
    out = []
    for p, _, t in rows:
        best = top[digest(t)]
        revisit = best is not None and p != best
        out.append((p, "revisit" if revisit else "response", len((t or "").encode()), digest(t), best if revisit else None))
    return sorted(out, key=str)


def write(spark, rows, **options):
    folder = new_path(spark, "warc-test")
    totals = warc.write_warc(spark.createDataFrame(rows, PAGE), folder, **options)
    return folder, totals


def read(spark, folder):
    return [r for r in warc.read_warc(spark, folder).collect()]


def test_whole_table_equals_sql(spark):
    same_as_oracle(warc.op9_warc_archive(spark, SF), warc.OP9_SQL)


ROWS = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, ""), (4, "http://c/\r\nX: y", None), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n"),
    (6, "u", "é" * 100), (6, "u", "é" * 100), (None, "u", "none"), (None, "u", "none"), (None, "u", "same"), (7, "http://ü/", "big " * 300_000),
]


def test_rows_come_back(spark):
    folder, (archives, records, size) = write(spark, ROWS)
    got = read(spark, folder)
    assert records == len(ROWS) == len(got) and archives >= 1 and size > 0
    assert sorted(((r["page_id"], r["warc_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got), key=str) == brute(ROWS)
    for r in got:
        if r["warc_type"] == "response":
            assert digest(r["payload"].decode()) == r["payload_digest"]
        else:
            assert r["payload"] is None


def test_small_payloads_are_all_responses(spark):
    folder, _ = write(spark, ROWS, min_bytes=10)
    got = [(r["page_id"], r["warc_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in read(spark, folder)]
    assert sorted(got, key=str) == brute(ROWS, 10)


def test_archives_have_a_dictionary_and_a_frame_a_record(spark):
    rows = [(i, f"http://h/{i}", f"<html><body><p>page {i} of the same site, with much in common</p>{i * 7919}</body></html>") for i in range(400)]
    folder, _ = write(spark, rows)
    frames = 0
    for path in glob.glob(f"{warc.file_system(folder)[1]}/*.warc.zst"):
        data = open(path, "rb").read()
        assert data[:4] == warc.DICT_MAGIC
        n = int.from_bytes(data[4:8], "little")
        opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + n]) if n else None)
        rest = data[8 + n :]
        while rest:
            one = opened.decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, frames = one.unused_data, frames + 1
    assert frames == 400


def test_small_archives_are_cut(monkeypatch):
    records = [b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"] * 5
    assert [b for _, b in warc.unpack_archive(warc.pack_archive(records))] == [b"abc"] * 5
    assert list(warc.unpack_archive(warc.pack_archive([]))) == []


def test_empty_table(spark):
    folder, totals = write(spark, [])
    assert totals == (0, 0, 0) or totals[1] == 0
    assert read(spark, folder) == []


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "u", "x", "y", 3)], PAGE + ", digest string, top int")
    folder = new_path(spark, "warc-test")
    warc.write_warc(df, folder)
    assert [r["payload"] for r in read(spark, folder)] == [b"x"]


def test_only_what_the_manifest_lists_is_read(spark):
    folder, _ = write(spark, ROWS)
    fs, root = warc.file_system(folder)
    # What an attempt that failed, or a task that ran again, may leave behind.
    with fs.open_output_stream(f"{root}/part-000000-00000-lost.warc.zst", compression=None) as out:
        out.write(warc.pack_archive([warc.record(99, "u", digest("x"), b"x", 1, None)]))
    assert len(read(spark, folder)) == len(ROWS)
    # Rows written anew, in another order and cut otherwise, replace the first archives.
    warc.write_warc(spark.createDataFrame(ROWS[::-1], PAGE).repartition(3), folder)
    assert len(read(spark, folder)) == len(ROWS)
    assert warc.read_warc(spark, new_path(spark, "nothing")).count() == 0
