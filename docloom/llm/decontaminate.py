"""Benchmark decontamination by containment search, with Spark expressions only.

A test item leaks into a document if the document holds at least ``threshold``
of the item's distinct five-word shingles. Items are partitioned by size; in a
partition of up to u shingles an item's sketch is its bottom-k MinHash, the
k = floor((1 - threshold) u) + 1 smallest of its shingle hashes. A document that
lacks all of them lacks more than the item can spare, so a probe of the sketches
with a document's shingle hashes finds every leak, however long the document is.
(A MinHash of the document itself would not: of thousands of shingles, few minima
come from a short item.) Candidates are then verified on the shingles themselves:
only the items' own shingles that stand in a candidate are counted.

A probe is one pass over the documents joined with the sketches, whose size is
checked before they are broadcast; bigger ones are joined by a shuffle, which
AQE splits where a frequent shingle fills a partition. The documents that it
finds are written as a table of keys and counted. Texts move only where that
table outgrows a broadcast, else the candidates' texts are picked in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.tables import materialize, sized

SHINGLE, THRESHOLD = 5, 0.8
WORD = r"[\p{L}\p{N}]+"
#: Sketch rows up to which the sketches are broadcast (about 40 bytes each).
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; none of a null text."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.expr("cast(array() as array<string>)"))


def _grams(w: Column, n: int, make) -> Column:
    whole = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda x, i: make(x, *(F.get(w, i + k) for k in range(1, n)))
    )
    return F.when(F.size(w) >= n, whole)


def _shingles(w: Column, make) -> Column:
    """An item's shingles; an item of fewer words is one shingle, without words it has none."""
    out = _grams(w, SHINGLE, make)
    for n in range(SHINGLE - 1, 0, -1):
        out = F.when(F.size(w) == n, _grams(w, n, make)).otherwise(out)
    return F.array_distinct(out)


def _text(*ws: Column) -> Column:
    return F.concat_ws(" ", *ws)


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, h) for the bottom-k MinHash of each item (item_id, w)."""
    hashes = items.select("item_id", _shingles(F.col("w"), F.xxhash64).alias("hs")).where("size(hs) > 0")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("hs").cast("double"))))
    k = F.floor(upper * (1 - threshold) + 1e-9).cast("int") + 1
    return hashes.select("item_id", F.explode_outer(F.slice(F.array_sort("hs"), F.lit(1), k)).alias("h"))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, doc_key, item_id, n_shared, n_item, containment) of every leak.

    ``doc_key`` is the text's hash: rows of one id but different texts are
    judged apart, repeated rows give one row. Items are distinct by id and
    text; items without an id are items, too. Null and wordless texts hold
    nothing and are held nowhere; an item of fewer than five words leaks where
    these words stand in a row. Other columns are ignored; an empty table on
    either side gives an empty result.
    """
    items = materialize(
        benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("w")).distinct(), "items"
    )
    sketch = materialize(sketches(items, threshold), "sketches").select("h").distinct()
    short = [r["n"] for r in items.select(F.size("w").alias("n")).where(f"n BETWEEN 1 AND {SHINGLE - 1}").distinct().collect()]
    sizes = [SHINGLE, *sorted(short)]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("doc_key", F.xxhash64("text"))

    def grams(make) -> Column:
        none = F.expr("cast(array() as array<bigint>)" if make is F.xxhash64 else "cast(array() as array<string>)")
        return F.concat(*(F.coalesce(_grams(F.col("w"), n, make), none) for n in sizes))

    probe = rows.select("doc_id", "doc_key", words(F.col("text")).alias("w")).select("doc_id", "doc_key", grams(F.xxhash64).alias("hs"))
    # The outer form keeps the optimizer from computing the array a second time in a filter.
    probe = probe.select("doc_id", "doc_key", F.explode_outer("hs").alias("h"))
    if sketch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sketch = F.broadcast(sketch)
    # A document's hits are one row before they are shuffled.
    found = sized(materialize(probe.join(sketch, "h").select("doc_id", "doc_key").distinct(), "candidates"))
    found = found.withColumnsRenamed({"doc_id": "f_id", "doc_key": "f_key"})
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("doc_key") == F.col("f_key"))
    held = rows.join(found, same, "left_semi").dropDuplicates(["doc_id", "doc_key"])
    held = held.select("doc_id", "doc_key", words(F.col("text")).alias("w")).select("doc_id", "doc_key", F.array_distinct(grams(_text)).alias("held"))
    held = held.select("doc_id", "doc_key", F.explode_outer("held").alias("shingle"))
    own = items.select("item_id", F.xxhash64("w").alias("item_key"), _shingles(F.col("w"), _text).alias("own"))
    own = own.select("item_id", "item_key", F.size("own").cast("long").alias("n_item"), F.explode("own").alias("shingle"))
    counted = held.join(sized(materialize(own, "shingles")), "shingle").groupBy("doc_id", "doc_key", "item_id", "item_key", "n_item")
    counted = counted.agg(F.count("*").alias("n_shared")).withColumn("containment", F.col("n_shared") / F.col("n_item"))
    counted = counted.where(F.col("containment") >= threshold).drop("item_key")
    return counted.select("doc_id", "doc_key", "item_id", "n_shared", "n_item", "containment").distinct()


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item; all their columns stay."""
    leaks = find_leaks(docs, benchmark, doc_id, text, **options).select(
        F.col("doc_id").alias("__leak_id"), F.col("doc_key").alias("__leak_key")
    )
    key = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    # Written first and counted, so that the documents needn't move to a short list.
    leaks = sized(materialize(leaks.distinct(), "leaks"))
    return docs.join(leaks, docs[doc_id].eqNullSafe(F.col("__leak_id")) & (key == F.col("__leak_key")), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.select("doc_id", "item_id", "n_shared", "n_item", "containment")


OP5_SQL = r"""
WITH i AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), item AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS n, array_to_string(w[k:k + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM i WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM item), held AS (
  SELECT DISTINCT row_no, doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT row_no, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), shared AS (
  SELECT h.row_no, h.doc_id, item.item_id, count(*) AS n_shared FROM held h JOIN item USING (n, s) GROUP BY ALL
), total AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id)
SELECT DISTINCT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN total USING (item_id) WHERE n_shared / n_item >= 0.8
"""
