"""Publishing translated rows to a second table by key, behind a running limit of errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import saved


def _key(name: str):
    return F.regexp_replace(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def publish_plan(source: DataFrame, target: DataFrame, key: str, id_field: str, columns: list[str], index: str = "row_index", target_order: str | None = None) -> DataFrame:
    """(row_index, key, product_id, payload): rows with a key; product_id is null where the target has none.

    Of equal keys in the target the last one counts, a blank id as none.  A null key is a blank one.
    """
    for df, names in ((source, [key]), (target, [key, id_field])):
        if missing := [n for n in names if n not in df.columns]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
    order = F.col(target_order) if target_order else F.col(f"`{id_field}`")
    known = target.select(_key(key).alias("key"), F.col(f"`{id_field}`").cast("string").alias("id"), order.alias("o")).where("key <> ''").groupBy("key").agg(F.max_by("id", "o").alias("product_id"))
    payload = F.to_json(F.struct(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns if c in source.columns)))
    rows = source.select(F.col(index).cast("string").alias("row_index"), F.col(index).alias("row_order"), _key(key).alias("key"), payload.alias("payload")).where("key <> ''")
    return rows.join(known, "key", "left").withColumn("product_id", F.when(F.col("product_id") != "", F.col("product_id")))


def blocked_from(results: DataFrame, order: str, failed: str, max_ratio: float, requests_before: int = 0, errors_before: int = 0) -> DataFrame:
    """(breach): the first row at which errors so far exceed ``max_ratio`` of requests so far; no rows if none does.

    Running sums go over ranges of rows: totals of ranges meet on the driver, rows do not.
    """
    ranged = saved(results.select(F.col(order).alias("o"), F.col(failed).cast("int").alias("f")).repartitionByRange("o").withColumn("part", F.spark_partition_id()))
    before, n, bad = [], requests_before, errors_before
    for r in ranged.groupBy("part").agg(F.count("*").alias("n"), F.sum("f").alias("bad")).orderBy("part").collect():
        before.append((r.part, n, bad))
        n, bad = n + r.n, bad + r.bad
    offsets = F.broadcast(results.sparkSession.createDataFrame(before, "part int, n0 long, bad0 long"))  # one row a partition
    w = Window.partitionBy("part").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.join(offsets, "part").select("o", (F.col("n0") + F.count("*").over(w)).alias("n"), (F.col("bad0") + F.sum("f").over(w)).alias("bad"))
    return running.where(F.col("bad") / F.greatest(F.col("n"), F.lit(1)) > max_ratio).agg(F.min("o").alias("breach")).where("breach is not null")


def publish_report(plan: DataFrame, results: DataFrame, breach) -> DataFrame:
    """(updated, missing, failed, blocked): counts up to the breach, if there is one."""
    limit = F.lit(breach) if breach is not None else None
    upto = lambda df: df if limit is None else df.where(F.col("row_order") <= limit)
    missing = upto(plan.where("product_id is null")).agg(F.count("*").alias("missing"))
    done = upto(results).agg(F.count_if("ok").alias("updated"), F.count_if(~F.col("ok")).alias("failed"))
    return done.crossJoin(missing).withColumn("blocked", F.lit(breach is not None))  # one row each
