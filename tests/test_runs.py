"""The publishing job and the job in waves."""

from __future__ import annotations

import json
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.config import RunConfig
from loomspan.operators import metrics, provider
from loomspan.operators.order import by_budget, greedy_cuts
from loomspan.plans.publish import publish_table
from loomspan.plans.run import run_job
from loomspan.sources import cache as store
from loomspan.sources.cache import CacheTable
from loomspan.sources.tables import Dialect, read_csv


def _tables(spark):
    source = spark.createDataFrame([(i, f"e{i}", f"n{i}") for i in range(40)], "row_index long, ean string, name string")
    target = spark.createDataFrame([(f"e{i}", i) for i in range(40) if i % 10], "ean string, id long")
    return source, target


def test_publish_stops_behind_the_wave_of_the_breach(spark):
    source, target = _tables(spark)
    stub = lambda rows: rows.select("row_index", "product_id", (F.col("row_order") < 20).alias("ok"), F.lit("").alias("message"))
    job = publish_table(source, target, "ean", "id", ["name"], config=RunConfig(publish_max_error_ratio=0.2), wave=9, send=stub)
    # rows 1 to 19 but 10 are 18 good ones; of 23 requests 5 failures are more than a fifth, at row 25
    assert job.report.first().asDict() == {"updated": 18, "failed": 5, "missing": 3, "blocked": True}
    assert job.results.count() == 36 and job.reasons == ["error_ratio"]
    faults = [(r.row_index, r.error_type) for r in job.faults.orderBy("row_order", "error_type").collect()]
    assert faults == [("0", "ean_not_found_on_sk"), ("10", "ean_not_found_on_sk"), *[(str(i), x) for i in range(20, 26) for x in ("ean_not_found_on_sk",)][:1], *[(str(i), "sk_update_error") for i in range(21, 26)], ("25", "sync_blocked_high_error_ratio")]
    assert job.faults.where("error_type = 'sync_blocked_high_error_ratio'").first().message == f"error ratio {5 / 23:.2%} is above 20.00%"


def test_publish_into_nothing_is_an_error(spark):
    source, target = _tables(spark)
    with pytest.raises(ValueError, match="no products"):
        publish_table(source, target.limit(0), "ean", "id", ["name"])


def test_the_last_of_equal_keys_counts(spark):
    source = spark.createDataFrame([(0, "e", "n")], "row_index long, ean string, name string")
    target = spark.createDataFrame([("e", 9, 1), ("e", 3, 2)], "ean string, id long, arrived long")
    stub = lambda rows: rows.select("row_index", "product_id", F.lit(True).alias("ok"), F.lit("").alias("message"))
    chosen = lambda **more: publish_table(source, target, "ean", "id", ["name"], send=stub, **more).results.first().product_id
    assert chosen() == "9" and chosen(target_order="arrived") == "3"


def test_publish_behind_a_closed_gate_sends_nothing(spark):
    source, target = _tables(spark)
    gate = spark.createDataFrame([(False, ["quality_fail_ratio"])], "passed boolean, reasons array<string>")

    def never(rows):
        raise AssertionError

    job = publish_table(source, target, "ean", "id", ["name"], gate=gate, send=never)
    assert job.report.first().asDict() == {"updated": 0, "failed": 0, "missing": 0, "blocked": True}
    assert job.reasons == ["quality_fail_ratio"]


class Slow(provider.Provider):
    """Sleeps, and writes when each call began and ended."""

    def __init__(self, log):
        self.log = log

    def translate(self, texts, source_lang, target_lang, strict=False):
        began = time.time()
        time.sleep(0.15)
        with open(f"{self.log}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{began} {time.time()} {len(texts)}")
        return [f"<{t}>" for t in texts]


class Misshapen(provider.Provider):
    """Never answers a list of several texts in shape."""

    def translate(self, texts, source_lang, target_lang, strict=False):
        if len(texts) > 1:
            raise provider.ShapeError("batch_parse_error")
        if texts == ["t5"]:
            raise OSError("down")
        return [texts[0].upper()]


def _most_at_once(folder):
    calls = [tuple(map(float, p.read_text().split())) for p in folder.iterdir()]
    edges = sorted([(a, 1) for a, _, _ in calls] + [(b, -1) for _, b, _ in calls])
    now = most = 0
    for _, step in edges:
        now += step
        most = max(most, now)
    return len(calls), most


@pytest.mark.parametrize("parallel,batch,calls", [(12, True, 40), (4, True, 40), (1, True, 40), (8, False, 120)])
def test_requests_overlap_within_the_bound(spark, tmp_path, monkeypatch, parallel, batch, calls):
    monkeypatch.setitem(provider.PROVIDERS, "slow", Slow)
    rows = [(i // 3, i, f"t{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "chunk_id long, seq long, segment string").repartition(5)
    out = provider.translate_chunks(df, "slow", options={"log": str(tmp_path)}, parallel=parallel, batch=batch).collect()
    assert {r.seq: r.translated for r in out if r.kind == "result"} == {i: f"<t{i}>" for i in range(120)}
    assert sorted(r.chunk_id for r in out if r.kind == "event") == list(range(40)) and all(r.success for r in out if r.kind == "event")
    n, most = _most_at_once(tmp_path)
    assert n == calls and parallel // 2 <= most <= parallel


def test_window_keeps_the_order_and_its_width():
    running, most, lock = 0, 0, threading.Lock()

    def call(i):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.02 * (i % 3))
        with lock:
            running -= 1
        return i * i

    with ThreadPoolExecutor(3) as pool:
        assert list(provider.overlapped(((i, lambda i=i: call(i)) for i in range(40)), pool, 3)) == [(i, i * i) for i in range(40)]
    assert most == 3


@pytest.mark.parametrize("recovery", ["singles", "halves"])
def test_batches_fall_back_to_single_requests(spark, monkeypatch, recovery):
    monkeypatch.setitem(provider.PROVIDERS, "misshapen", Misshapen)
    df = spark.createDataFrame([(i // 4, i, f"t{i}") for i in range(9)], "chunk_id long, seq long, segment string")
    out = provider.translate_chunks(df, "misshapen", retries=1, recovery=recovery).collect()
    got, events = {r.seq: r.translated for r in out if r.kind == "result"}, sorted((r.chunk_id, r.mode, r.success, r.fallback_used, r.input_count) for r in out if r.kind == "event")
    if recovery == "singles":
        assert got == {i: None if i == 5 else f"T{i}" for i in range(9)}
        assert events == [(0, "batch", False, True, 4), (0, "single", True, False, 4), (1, "batch", False, True, 4), (1, "single", False, False, 4), (2, "batch", True, False, 1)]
    else:  # an error that is no shape error ends a chunk's only try
        assert got == {i: None if 4 <= i < 8 else f"T{i}" for i in range(9)}
        assert events == [(0, "batch", True, True, 4), (1, "batch", False, False, 4), (2, "batch", True, False, 1)]


def test_waves_learn_from_each_other(spark):
    rows = [(i, f"slovo {i % 7} text") for i in range(30)] + [(30, None), (31, "")]
    df = spark.createDataFrame(rows, "row_index long, name string")
    seen = []
    run = run_job(df, ["name"], spark.createDataFrame([], store.SCHEMA), "prefix", RunConfig(source_lang="en", target_lang="de", cells_per_run=15), waves=2, after=lambda k, s, c: seen.append((k, c.count())))
    assert {r.row_index: r.name for r in run.table.collect()} == {i: f"new:{t}" if t else t for i, t in rows}
    assert [k for k, _ in seen] == [0, 1] and seen[0][1] == seen[1][1] == 7
    assert [s.batch for s in run.states] == [1, 2]
    assert run.gate.first().passed and run.metrics.first().cell_reject_ratio == 0
    assert [(r.wave, r.segments, r.cache_misses, r.translated_cells) for r in run.log.orderBy("wave").collect()] == [(0, 15, 15, 15), (1, 15, 0, 15)]


class Stopped(Exception):
    pass


@pytest.mark.parametrize("stops", [[0, 1]])
def test_a_resumed_run_gives_what_one_run_gives(spark, tmp_path, stops):
    rows = [(i, f"slovo {i % 37} zpětný text" if i % 5 else f"jiné {i}", f"<p>odstavec {i % 11}</p>") for i in range(44)]
    df = spark.createDataFrame(rows, "row_index long, name string, body string")
    config = RunConfig(cells_per_run=20, misses_per_run=10, cache_sample_rate=1.0)
    key = lambda t: F.sha2(F.lit(f"{t}|cs|sk|prefix|default"), 256)
    cache = spark.range(1).select(key("slovo 1 zpětný text").alias("key"), F.lit("slovo 1 zpětný text").alias("translated"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"), F.lit(-1).cast("long").alias("batch_id"))
    go = lambda folder, known, after=None: run_job(df, ["name", "body"], known, "prefix", config, waves=4, store=f"file://{tmp_path}/{folder}", after=after)
    whole = go("whole", cache)
    for stop in stops:

        def halt(k, state, known, stop=stop):
            if k == stop:
                raise Stopped

        with pytest.raises(Stopped):
            go("parts", cache, halt)
    # what others have put into the cache meanwhile does not move the batches
    grown = cache.unionByName(spark.range(1).select(key("slovo 2 zpětný text").alias("key"), F.lit("x").alias("translated"), F.lit("2025-01-01").cast("timestamp").alias("updated_at"), F.lit(9).cast("long").alias("batch_id")))
    parts = go("parts", grown)
    rows_of = lambda d, *drop: sorted(map(str, d.drop(*drop).collect()))
    for name in ("table", "cells", "report", "quality_report", "log"):
        assert rows_of(getattr(parts, name)) == rows_of(getattr(whole, name)), name
    assert len(parts.states) == len(whole.states) == 3 and parts.states == whole.states
    assert rows_of(parts.events, "latency_ms") == rows_of(whole.events, "latency_ms")
    assert whole.report.count() > 0 and whole.quality_report.where("action = 'cache_rejected'").select("source_hash").distinct().count() == 1
    assert {r.row_index: r.name for r in parts.table.collect()} == {i: n if i % 5 else f"new:{n}" for i, n, _ in rows}


def test_a_folder_of_another_run_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c")], "row_index long, name string")
    empty = spark.createDataFrame([], store.SCHEMA)
    config = RunConfig(source_lang="en", target_lang="de")
    run_job(df, ["name"], empty, "prefix", config, store=f"file://{tmp_path}/r")
    with pytest.raises(ValueError, match="another|other"):
        run_job(df, ["name"], empty, "identity", config, store=f"file://{tmp_path}/r")


def test_artifacts_and_telemetry_of_a_run(spark, tmp_path):
    df = spark.createDataFrame([(i, f"slovo číslo {i} je dlouhé" if i else "který zpětný chod vozu") for i in range(6)], "row_index long, name string")
    config = RunConfig(telemetry="jsonl", telemetry_path=f"file://{tmp_path}/telemetry", cells_per_run=2, checkpoint_every=2, min_quality_samples=1)
    run_job(df, ["name"], spark.createDataFrame([], store.SCHEMA), "prefix", config, waves=3, artifacts=f"file://{tmp_path}/out")
    told = spark.read.json(f"file://{tmp_path}/telemetry").orderBy("phase").collect()
    assert [r.phase for r in told] == ["checkpoint", "checkpoint", "completed"] and len({r.run_id for r in told}) == 1
    assert told[2].metrics.cell_reject_ratio == pytest.approx(1 / 6) and not told[2].run_gate.passed
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == ["cache", "quality", "report", "summary", "translated"]
    summary = json.loads(spark.read.json(f"file://{tmp_path}/out/summary").first().summary)
    assert summary["errors"] == {"quality_gate_failed": 1} and summary["actions"]["not_cached"] == 1
    assert len(spark.read.csv(f"file://{tmp_path}/out/translated", sep=";", header=True).collect()) == 6


def test_no_cells_at_all(spark):
    df = spark.createDataFrame([(1, " "), (2, None)], "row_index long, name string")
    run = run_job(df, ["name"], spark.createDataFrame([], store.SCHEMA), "prefix")
    assert sorted(map(tuple, run.table.collect())) == [(1, " "), (2, None)] and run.states == [] and run.gate.first().passed


def test_answers_in_the_first_wrapper_that_is_a_list():
    assert provider.read_answer('{"translations": null, "items": [{"id": 1, "translated": "x"}, {"id": " b ", "text": "y"}, {"id": [1]}]}', ["1", "b"]) == {"1": "x", "b": "y"}


def test_p95_of_all_values(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("v"))
    assert tuple(metrics.p95(df, "v").first()) == (950.0, 1000)
    assert tuple(metrics.p95(df.limit(0), "v").first()) == (0.0, 0)


@pytest.mark.parametrize("block,wing", [(50, 2), (50, 1000), (7, 3)])
def test_cuts_across_blocks_and_wings(spark, block, wing):
    weights = [(i * 37 % 11) + 1.0 for i in range(333)]
    df = spark.createDataFrame(list(enumerate(weights)), "seq long, weight double")
    got = {r.seq: r.group for r in greedy_cuts(df, by_budget(20.0, 6), ["weight"], 6, block=block, wing=wing).collect()}
    group, total, n, expected = 0, 0.0, 0, {}
    for i, w in enumerate(weights):
        if n and (n == 6 or total + w > 20.0):
            group, total, n = group + 1, 0.0, 0
        total, n = total + w, n + 1
        expected[i] = group
    assert got == expected


def _cached(spark, key, value, batch=1):
    return spark.createDataFrame([(key, value)], "key string, translated string").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")).withColumn("batch_id", F.lit(batch).cast("long"))


def _rows(cache):
    return {r.key: r.translated for r in cache.load().collect()}


def test_cache_keeps_both_savers_and_survives_damage(spark, tmp_path):
    root = f"file://{tmp_path}/cache"
    CacheTable(spark, root).save(_cached(spark, "a", "1"))
    CacheTable(spark, root).save(_cached(spark, "b", "2"))
    CacheTable(spark, root).save(_cached(spark, "a", "0", 0))  # older: the first stays
    assert _rows(CacheTable(spark, root)) == {"a": "1", "b": "2"}
    folder = tmp_path / "cache" / CacheTable(spark, root).log()[0]["add"]
    for part in folder.glob("*.parquet"):
        part.write_bytes(b"damaged")
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    assert _rows(CacheTable(spark, root)) == {}
    CacheTable(spark, root).save(_cached(spark, "c", "3"))
    assert _rows(CacheTable(spark, root)) == {"c": "3"} and any(p.name.startswith("log.corrupt-") for p in (tmp_path / "cache").iterdir())


@pytest.mark.parametrize("step", ["table", "number", "base"])
def test_interleaved_savers_keep_all_rows(spark, tmp_path, step):
    """One saver does its whole work while another stands at a step of its own."""
    root = f"file://{tmp_path}/{step}"
    one, two = CacheTable(spark, root, compact_after=2), CacheTable(spark, root, compact_after=2)
    one.save(_cached(spark, "first", "0"))
    done = []

    def meanwhile():
        if not done:
            done.append(1)
            two.save(_cached(spark, "two", "2"))
            assert _rows(two)["two"] == "2"

    if step == "table":  # its table is written, the log not yet read
        log = one.log
        one.log = lambda: (meanwhile(), log())[1]
    elif step == "number":  # it has chosen a number and is about to take it
        create = one.files.create
        one.files.create = lambda *a: (meanwhile(), create(*a))[1]
    else:  # it has read what its base will hold
        rows = one._rows
        one._rows = lambda tables: (meanwhile(), rows(tables))[1]
    one.save(_cached(spark, "one", "1"))
    assert done and _rows(CacheTable(spark, root)) == {"first": "0", "one": "1", "two": "2"}
    numbers = [e["number"] for e in CacheTable(spark, root).log()]
    assert numbers == list(range(1, len(numbers) + 1)) and any("base" in e for e in CacheTable(spark, root).log())
    CacheTable(spark, root).clean()
    assert _rows(CacheTable(spark, root)) == {"first": "0", "one": "1", "two": "2"}


def test_savers_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/cache"
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: CacheTable(spark, root, compact_after=3).save(_cached(spark, f"k{i}", str(i))), range(8)))
    assert _rows(CacheTable(spark, root)) == {f"k{i}": str(i) for i in range(8)}


def test_csv_with_and_without_quoted_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;y\n1;"two ""q"" words"\n2;plain\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('x;y\n1;"two\nlines"\n2;plain\n', encoding="utf-8")
    read = lambda name: [(r.row_index, r.x, r.y) for r in read_csv(spark, f"file://{tmp_path}/{name}", Dialect())[0].orderBy("row_index").collect()]
    assert read("a.csv") == [(0, "1", 'two "q" words'), (1, "2", "plain")]
    assert read("b.csv") == [(0, "1", "two\nlines"), (1, "2", "plain")]


def test_answers_of_small_chunks_are_batched():
    """Chunks go through as lists, also where batches cut them, and many of them come back in one batch."""
    cols = ["chunk_id", "seq", "segment"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(s, pa.int64()), pa.array(t)], cols) for c, s, t in (([0, 0, 1], [0, 1, 2], ["a", "b", "c"]), ([1, 2], [3, 4], ["d", None]))]
    assert list(provider._chunks(iter(batches))) == [(0, [0, 1], ["a", "b"]), (1, [2, 3], ["c", "d"]), (2, [4], [None])]
    out = provider._batch([("result", 0, 1, "a", "x", *(None,) * 8), ("event", 0, None, None, None, "batch", 1, 1, 3, True, None, False, 0)])
    assert out.num_rows == 2 and out.schema.names == [f.split()[0] for f in provider.SCHEMA.split(", ")]
    assert out.column("translated").to_pylist() == ["x", None] and out.column("latency_ms").to_pylist() == [None, 3]
