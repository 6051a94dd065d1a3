"""The k greatest values of each group by distributed radix select, with ties settled by the bytes of the items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, small_side

#: Bits of a value that one histogram covers, and bytes of an item.
BITS, BYTES = 16, 8


def _same(left: str, right: str, groups: list[str]):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{g}").eqNullSafe(F.col(f"{right}.{g}")) for g in groups])


def _chosen(histogram: DataFrame, groups: list[str], digit: str, descending: bool) -> DataFrame:
    """(groups, digit, need, n): the digit at which a group's count reaches what it needs, how many of its ``n`` rows are needed."""
    order = F.col(digit).desc() if descending else F.col(digit).asc()
    w = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = histogram.withColumn("upto", F.sum("n").over(w)).where("upto >= need and upto - n < need")
    return met.select(*groups, digit, (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "n")


def thresholds(rows: DataFrame, groups: list[str], value: str, k: int, ws: Workspace) -> DataFrame:
    """(groups, threshold, need, n): the k-th greatest value of each group of k rows or more, how many rows of that value
    belong to the k greatest, and how many there are.

    Each round counts one digit of the values that agree with their group's threshold so far.  A histogram has
    a row for each group and digit that occurs, and counts are added up in the tasks first, so groups may be of any size.
    """
    top = rows.agg(F.max(value)).first()[0] or 0
    if rows.where(F.col(value) < 0).limit(1).count():
        raise ValueError("values must not be negative")
    state, shift = None, max(0, -(-max(1, int(top).bit_length()) // BITS) - 1) * BITS
    while shift >= 0:
        digit = F.shiftright(F.col(value), shift).bitwiseAND(F.lit((1 << BITS) - 1))
        if state is None:
            at = rows.select(*groups, digit.alias("digit"), F.lit(0).cast("long").alias("high"), F.lit(k).cast("long").alias("need"))
        else:
            a, b = rows.alias("a"), small_side(state).alias("b")
            at = a.join(b, _same("a", "b", groups) & (F.shiftright(F.col(f"a.{value}"), shift + BITS) == F.col("b.high")))
            at = at.select(*(F.col(f"a.{g}").alias(g) for g in groups), digit.alias("digit"), "b.high", "b.need")
        histogram = at.groupBy(*groups, "digit", "high", "need").agg(F.count("*").alias("n"))
        found = _chosen(histogram.withColumn("whole", F.col("high") * (1 << BITS) + F.col("digit")), groups, "whole", True)
        state = ws.save(found.withColumnRenamed("whole", "high"), f"digits{shift}")
        shift -= BITS
    return state.withColumnRenamed("high", "threshold")


def top_k(rows: DataFrame, groups: list[str], value: str, item: str, k: int, ws: Workspace) -> DataFrame:
    """``rows`` that are the k greatest of their group, with rank from 1; of equal values the item first in UTF-8 order.

    Values are 64-bit integers, not negative.  Groups of fewer than k rows are returned whole; null groups are groups.
    Rows equal in group, value and item take different ranks in any order.  A group of any size, and any number
    of ties, is counted and not gathered: a window holds k rows.  No rows give no rows.
    """
    names = rows.columns
    state = thresholds(rows, groups, value, k, ws)
    a, b = rows.alias("a"), small_side(state).alias("b")
    placed = a.join(b, _same("a", "b", groups), "left").select(*(F.col(f"a.{c}").alias(c) for c in names), "b.threshold", "b.need", "b.n")
    sure = placed.where(F.col("threshold").isNull() | (F.col(value) > F.col("threshold")) | ((F.col(value) == F.col("threshold")) & (F.col("need") == F.col("n")))).select(*names)
    tied = ws.save(placed.where((F.col(value) == F.col("threshold")) & (F.col("need") < F.col("n"))).select(*names, "need"), "tied0")
    at = 0
    while not tied.isEmpty():
        bytes_ = F.hex(F.substring(F.encode(F.col(item), "UTF-8"), BYTES * at + 1, BYTES))
        part = tied.withColumn("chunk", F.coalesce(bytes_, F.lit("")))
        histogram = part.groupBy(*groups, "chunk", "need").agg(F.count("*").alias("n"))
        edge = ws.save(_chosen(histogram, groups, "chunk", False), f"chunk{at}")
        c, d = part.drop("need").alias("c"), small_side(edge.select(*groups, F.col("chunk").alias("edge"), "need", "n")).alias("d")
        met = c.join(d, _same("c", "d", groups)).select(*(F.col(f"c.{x}").alias(x) for x in names), "c.chunk", "d.edge", "d.need", "d.n")
        sure = sure.unionByName(met.where("chunk < edge or (chunk = edge and need = n)").select(*names))
        open_ = met.where("chunk = edge and need < n")
        # an empty chunk: the items ended together, so the rows are equal
        equal = open_.where("edge = ''").withColumn("r", F.row_number().over(Window.partitionBy(*groups).orderBy(F.lit(0)))).where("r <= need")
        sure = sure.unionByName(equal.select(*names))
        at += 1
        tied = ws.save(open_.where("edge <> ''").select(*names, "need"), f"tied{at}")
    w = Window.partitionBy(*groups).orderBy(F.col(value).desc(), F.col(item).asc())
    return sure.withColumn("rank", F.row_number().over(w))
