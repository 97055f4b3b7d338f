"""Small inputs and brute-force versions for the operators' tests."""

from __future__ import annotations

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents pages benchmark labels conversations embeddings".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *("en", "a")[len(r) - 2 :])[:4] if len(r) < 4 else r for r in rows]
    return spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in full], DOCS)


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, (int, float)) or x is None else (False, "n", x) for x in r))


def oracle(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def same_as_oracle(df, sql, sf=SF):
    names, rows = oracle(sql, sf)
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=key)
    want = sorted(rows, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-9) for x, y in zip(a, b, strict=True)), (a, b)
