"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over (u, v) with u > v.

    Minima are partial aggregates, and neighbours are met by a join that adaptive execution can split,
    so a hub with any number of neighbours never has to fit in one task.
    """
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = near.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def connected_components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) for every node that ``edges`` (a, b) touch; component is the smallest node reachable.

    Self links are ignored, direction and repetition do not matter, no edges give no rows.  Rounds stop
    when a pair of them changes nothing, which the driver learns from a count and a checksum only.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = ws.save(now, f"{name}0")
    seen, k = None, 0
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen, k = mark, k + 1
        now = ws.save(_star(_star(now, True), False), f"{name}{k}")
        ws.drop(f"{name}{k - 1}")
