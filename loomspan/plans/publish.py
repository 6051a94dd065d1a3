"""The publishing job: run gate, plan, requests in waves behind a breaker, and a report."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators.order import saved, with_index
from ..operators.publish import blocked_from, publish_plan, publish_report
from ..sources.rest import patch_products
from ..sources.scratch import shared_folder

RESULTS = "row_index string, product_id string, ok boolean, message string, row_order {}"


@dataclass
class Published:
    """The plan, what was sent, counts (updated, failed, missing, blocked), why nothing more was sent, and a row for each fault."""

    plan: DataFrame
    results: DataFrame
    report: DataFrame
    reasons: list[str]
    faults: DataFrame


def faults_of(plan: DataFrame, results: DataFrame, key: str, breach, ratio: float, limit: float) -> DataFrame:
    """(row_index, column, error_type, message) in the order of rows: keys that the target lacks, updates that failed, and
    the row at which publishing was blocked; nothing behind that row."""
    upto = lambda df: df if breach is None else df.where(F.col("row_order") <= F.lit(breach))
    line = lambda kind, message: (F.lit(key).alias("column"), F.lit(kind).alias("error_type"), message.alias("message"))
    lost = upto(plan.where("product_id is null")).select("row_index", "row_order", *line("ean_not_found_on_sk", F.concat(F.lit("no product has the key "), "key")))
    keyed = results.where(~F.col("ok")).join(plan.select(F.col("row_index").alias("__r"), "key"), F.col("row_index") == F.col("__r"))
    failed = upto(keyed).select("row_index", "row_order", *line("sk_update_error", F.concat(F.col("key"), F.lit(": "), F.coalesce("message", F.lit("")))))
    blocked = plan.where(F.lit(False) if breach is None else F.col("row_order") == F.lit(breach))
    blocked = blocked.select("row_index", "row_order", *line("sync_blocked_high_error_ratio", F.lit(f"error ratio {ratio:.2%} is above {limit:.2%}")))
    return lost.unionByName(failed).unionByName(blocked)


def publish_table(
    source: DataFrame, target: DataFrame, key: str, id_field: str, columns: list[str], options: dict | None = None, gate: DataFrame | None = None,
    config: RunConfig | None = None, wave: int = 1_000, requests_before: int = 0, errors_before: int = 0, send: Callable[[DataFrame], DataFrame] | None = None, target_order: str | None = None,
    growth: int = 4,
) -> Published:
    """Patch each row of ``source`` whose key ``target`` has.

    ``gate`` (passed, reasons) of a run that did not pass blocks everything; a target without rows is an error.  Rows go out
    in order, ``wave`` at first, each wave as one distributed job; its answers are written before they are counted, so no
    row is sent twice.  Once errors exceed the configured share of requests, no further wave is sent, and
    the report counts up to the row where that happened.  While all is well each wave is ``growth`` times as large as the one
    before, so long tables take few waves and an early fault stops a small one.  ``send`` takes rows (row_index,
    product_id, payload, row_order) and gives (row_index, product_id, ok, message); it is ``patch_products`` by default.

    Of equal keys in the target the last by ``target_order`` counts, or by the id if none is named.
    """
    config = config or RunConfig()
    spark = source.sparkSession
    if target.isEmpty():
        raise ValueError("the target has no products")
    plan = saved(publish_plan(source, target, key, id_field, columns, target_order=target_order))
    kind = plan.schema["row_order"].dataType.simpleString()
    results = spark.createDataFrame([], RESULTS.format(kind))
    limit = config.publish_max_error_ratio
    verdict = gate.first() if gate is not None else None
    if verdict is not None and not verdict.passed:
        blocked = publish_report(plan.limit(0), results, None).withColumn("blocked", F.lit(True))
        return Published(plan, results, blocked, list(verdict.reasons), faults_of(plan.limit(0), results, key, None, 0.0, limit))
    send = send or (lambda rows: patch_products(rows, options or {}))
    rows = saved(with_index(plan.where("product_id is not null"), ["row_order"]))
    breach, ratio, requests, errors = None, 0.0, requests_before, errors_before
    total, lo, parts = rows.count(), 0, []
    folder = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    while lo < total and breach is None:
        part = rows.where(F.col("seq").between(lo, lo + wave - 1))
        # row_index is row_order as text, and may repeat
        send(part).withColumn("row_order", F.col("row_index").cast(kind)).select(*results.columns).write.parquet(f"{folder}/wave={len(parts)}")
        parts.append(f"{folder}/wave={len(parts)}")
        sent = spark.read.schema(results.schema).parquet(parts[-1])
        found = blocked_from(sent.withColumn("failed", ~F.col("ok")), "row_order", "failed", limit, requests, errors).first()
        if found:
            breach = found.breach
            upto = sent.where(F.col("row_order") <= F.lit(breach))
        counts = (upto if found else sent).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad")).first()
        requests, errors = requests + counts.n, errors + counts.bad
        ratio = errors / max(1, requests)
        lo, wave = lo + wave, wave * growth
    if parts:
        results = spark.read.schema(results.schema).parquet(*parts)  # one scan, however many waves
    return Published(plan, results, publish_report(plan, results, breach), [] if breach is None else ["error_ratio"], faults_of(plan, results, key, breach, ratio, limit))
