"""The last calls of each provider on a stream, and what they come to."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

_CALL = StructType([StructField("at", LongType()), StructField("ok", BooleanType()), StructField("fallback", BooleanType()), StructField("chars", LongType()), StructField("items", LongType()), StructField("ms", LongType())])
_TOTAL = StructType([StructField(c, LongType()) for c in ("requests", "errors", "fallbacks")])
FIELDS = ("requests", "errors", "fallbacks", "recent_requests", "recent_successes", "recent_errors", "recent_chars", "recent_items", "recent_latency_ms")


class _Ring(StatefulProcessor):
    """Of each key the last ``k`` calls in their own order, whenever they arrive, and counts of all."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls, self.total = handle.getListState("calls", _CALL), handle.getValueState("total", _TOTAL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        requests, errors, fallbacks = self.total.get() if self.total.exists() else (0, 0, 0)
        held = [tuple(x) for x in self.calls.get()] if self.calls.exists() else []
        for f in rows:
            requests, errors, fallbacks = requests + len(f), errors + int((~f["success"]).sum()), fallbacks + int(f["fallback_used"].sum())
            new = f.nlargest(self.k, "at")
            held += [(int(a), bool(o), bool(b), int(c), int(i), int(m)) for a, o, b, c, i, m in zip(new["at"], new["success"], new["fallback_used"], new["input_chars"], new["input_count"], new["latency_ms"], strict=True)]
            held = sorted(held)[-self.k :]
        self.calls.put(held)
        self.total.update((requests, errors, fallbacks))
        good = sum(x[1] for x in held)
        sums = [sum(x[i] for x in held) for i in (3, 4, 5)]
        yield pd.DataFrame([(*key, requests, errors, fallbacks, len(held), good, len(held) - good, *sums)], columns=["key", *FIELDS])

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """State of several variables a key needs the embedded store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def recent_calls(events: DataFrame, key: str, order: str, last: int = 200) -> DataFrame:
    """(key, requests ... recent_latency_ms) for each key that a batch of the stream ``events`` touches: lifetime counts, and sums over
    its ``last`` calls by ``order``.  A key's row replaces its earlier ones; its state is at most ``last`` calls.
    """
    from pyspark.sql import functions as F

    calls = events.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("at"), "success", "fallback_used", "input_chars", "input_count", "latency_ms")
    shape = "key string, " + ", ".join(f"{c} long" for c in FIELDS)
    return calls.groupBy("key").transformWithStateInPandas(_Ring(last), shape, "Update", "None")
