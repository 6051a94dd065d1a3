"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, partitions_for


def balanced_shards(docs: DataFrame, n_shards: int = 24, rows_per_part: int = 1_000_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): documents in ascending doc_id, cut at equal byte targets.

    A document's size is its UTF-8 bytes plus 8.  It goes to the shard in whose n-th part of all bytes
    its first byte lies, so shards are contiguous and differ by one document's size at most.  Sums run
    within range partitions; only one total for each partition passes through the driver.

    A null or empty text has size 8 and crc 0.  Rows without doc_id come first; equal doc_ids are
    ordered by size and crc, and fully equal rows are interchangeable.  No rows give no rows.  Columns
    other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "shards")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = ws.save(docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")), "slim")
    order = ["doc_id", "size", "text_crc32"]
    parts = partitions_for(spark, slim.count(), rows_per_part)
    # written once, so that totals and running sums see the same partitions even after a lost executor
    ranged = ws.save(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("r")).orderBy("part").collect()
    before, bytes_, rows = [], 0, 0
    for t in totals:
        before.append((t.part, bytes_, rows))
        bytes_, rows = bytes_ + t.b, rows + t.r
    # one row for each partition: as many as repartitionByRange was given at most
    offsets = F.broadcast(spark.createDataFrame(before, "part int, bytes_before long, rows_before long"))
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(offsets, "part").select(
        *order,
        (F.col("bytes_before") + F.coalesce(F.sum("size").over(w), F.lit(0))).alias("byte"),
        (F.col("rows_before") + F.count("*").over(w)).alias("row"),
    )
    shard = F.expr(f"cast(least({n_shards - 1}, byte * {n_shards} div {max(bytes_, 1)}) as int)")
    placed = ws.save(placed.withColumn("shard", shard), "placed")
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("row").alias("first_row")))  # n_shards rows at most
    return placed.join(firsts, "shard").select(*order, "shard", (F.col("row") - F.col("first_row")).alias("slot"))
