"""Mixing sources to target weights, with Spark expressions only.

Weighted fair queueing: a source's documents stand in shuffled order and each
copy of a document gets a virtual finish time, the source's words up to its end
over the source's target. All copies are range-sorted by finish time and
truncated where their words reach the total budget.

Running totals (over the sources, over each source's documents, over all
copies) come from global range sorts: sums per range, run up, then totals
inside each range. A source that holds a third of all rows fills a third of the
ranges; no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.tables import materialize, running_totals, sized

WEIGHTS, SHARE, MAX_REPEAT = (5.0, 2.0, 1.0), 1.5, 2


def word_count(text: Column) -> Column:
    """Runs of characters other than the six ASCII blanks; 0 of a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, before, target) from rows (source, size).

    Weights repeat along the sources in code-point order, null last; ``before``
    is the size of all sources ahead of one in this order. Targets share
    ``share`` of all sizes by weight; where one would be over ``repeat`` times
    its source's size it stops there and the rest is shared out anew. That is
    the level t at which the sum of min(t weight, repeat size) is the budget; it
    lies between two of the sources' own levels, so one running total over them
    in order of level finds it. Three numbers come to the driver.
    """
    by_name = F.col("source").asc_nulls_last()
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    per = running_totals(per, [by_name], {"rank": F.lit(1), "before": F.col("source_size")}, "ranked")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(repeat)).withColumn("level", F.col("cap") / F.col("weight"))
    levels = running_totals(per, ["level", by_name], {"capped": F.col("cap"), "lighter": F.col("weight")}, "levels")
    total, heavy = per.agg(F.sum("source_size"), F.sum("weight")).first()
    levels = levels.withColumn("t", (F.lit((total or 0) * share) - F.col("capped")) / (F.lit(heavy or 1.0) - F.col("lighter")))
    # The first source, by level, that the level reached before it doesn't fill sets the level of all.
    first = levels.where("t <= level").agg(F.min(F.struct("level", F.col("source").isNull().alias("last"), "source", "t"))).first()[0]
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first["t"]) * F.col("weight"))
    return per.select("source", "source_size", "before", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    repeat: int = MAX_REPEAT,
    seed: str = "",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row.

    Documents are shuffled by the MD5 of seed and id, so reruns agree, and are
    taken whole, at most ``repeat`` times; ``taken`` is copies times size. A
    copy that the budget cuts is taken if more than half of it fits, so a
    source misses its target by half a document at most. Null texts have size 0,
    and rows of size 0 are never taken. Null sources are one source, the last.
    Null ids are shuffled as the empty text; repeated rows count each, in a
    fixed order. An empty table gives an empty one.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")
    )
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialize(rows.withColumn("u", order), "sizes")
    targets = materialize(source_targets(rows, weights, share, repeat), "targets")
    by_name = F.col("source").asc_nulls_last()
    rows = running_totals(rows, [by_name, "u", "doc_id", "size"], {"start": F.col("size")}, "queue")
    # One row per source: broadcast while small, else joined by a shuffle that AQE splits at hot sources.
    few = sized(targets.withColumnRenamed("source", "t_source"))
    rows = rows.join(few, rows["source"].eqNullSafe(few["t_source"])).drop("t_source")
    rows = materialize(rows.withColumn("start", F.col("start") - F.col("before")).drop("before"), "queued")
    copies = rows.where("size > 0 AND target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    end = F.col("copy") * F.col("source_size") + F.col("start") + F.col("size")
    # Virtual time ends at about 1; what is far beyond needs no place in the order.
    copies = copies.select("source", "u", "doc_id", "copy", "size", (end / F.col("target")).alias("finish")).where("finish < 2")
    queue = running_totals(copies, ["finish", by_name, "u", "doc_id", "copy"], {"used": F.col("size")}, "copies")
    # Two single numbers come to the driver: the total budget, and the virtual time at which it is used up.
    budget = targets.agg(F.round(F.sum("target"), 6)).first()[0] or 0.0
    ends = queue.where(F.col("used") + F.col("size") >= budget).agg(F.min("finish")).first()[0]
    ends = F.lit(1.0 if ends is None else float(ends))
    # A copy is taken if its middle comes before the time at which the budget is used up.
    middle = lambda c: (c * F.col("source_size") + F.col("start") + F.col("size") / 2) / F.col("target")
    taken = sum(
        (F.when((F.col("size") > 0) & (F.col("target") > 0) & (middle(c) <= ends), 1).otherwise(0) for c in range(repeat)),
        F.lit(0),
    )
    out = rows.withColumn("copies", taken.cast("long"))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS u,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight
  FROM d GROUP BY source
), lev AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS level FROM per
), tot AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget,
    coalesce(sum(cap) OVER b, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open
  FROM lev WINDOW b AS (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT first((budget - capped) / open ORDER BY level, source ASC NULLS LAST)
    FILTER ((budget - capped) / open <= level) AS t FROM tot
), target AS (
  SELECT source, source_size, least(cap, coalesce((SELECT t FROM t) * weight, cap)) AS target FROM tot
), q AS (
  SELECT d.*, g.source_size, g.target,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN target g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
  SELECT *, (copy * source_size + start + size) / target AS finish
  FROM q, (VALUES (0), (1)) AS v(copy) WHERE size > 0 AND target > 0
), r AS (
  SELECT finish, sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, u, doc_id, copy ROWS UNBOUNDED PRECEDING) AS r FROM c
), ends AS (
  SELECT coalesce(min(finish), 1.0) AS ends FROM r WHERE r >= (SELECT round(sum(target), 6) FROM target)
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 AND target > 0 THEN
    size * (CAST((start + size / 2) / target <= (SELECT ends FROM ends) AS INTEGER)
      + CAST((source_size + start + size / 2) / target <= (SELECT ends FROM ends) AS INTEGER)) ELSE 0 END AS BIGINT) AS taken
FROM q
"""
