"""Connected components of an edge table, by alternating stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): every
round hangs each node's larger neighbours under its smallest one, then the
smaller ones likewise. The edge table never grows, stars are fixed points, and
the number of rounds grows with the logarithm of the node count. Each round is
one table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.tables import materialize


def _hang(neighbours: DataFrame, *, larger: bool) -> DataFrame:
    """One star operation over rows (u, v): v is a neighbour of u."""
    least = neighbours.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = neighbours.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """Label every node that has an edge with the smallest node it reaches.

    Returns (node, component). Edges with a null end and loops carry no link
    and give no row; repeated edges count once; an empty table gives an empty
    one. Node columns may be of any orderable type. Raises if ``max_rounds``
    rounds don't suffice (the bound is logarithmic, so that means bad input).
    """
    e = edges.select(F.col(left).alias("x"), F.col(right).alias("y")).where("x <> y")
    e = materialize(
        e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges"
    )
    before = _signature(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_hang(both, larger=True).distinct(), "edges")
        e = materialize(_hang(large, larger=False).distinct(), "edges")
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
