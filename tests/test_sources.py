import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomspan.operators.publish import blocked_from, publish_plan, publish_report
from loomspan.sources.cache import CacheTable, import_json
from loomspan.sources.rest import ApiError, Client, ProductSource, RetryableApiError, Sent, items_of, normal_url, patch_products, read_products, write_products
from loomspan.sources.tables import Dialect, detect_dialect, read_csv, write_csv


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('﻿a;b\n1;"x;""y"\n;"zwei\nZeilen"\nž;\n', encoding="utf-8")
    dialect = detect_dialect(spark, str(path))
    assert dialect == Dialect("utf-8-sig", ";")
    df, _ = read_csv(spark, str(path))
    rows = [tuple(r) for r in df.orderBy("row_index").collect()]
    assert [r[1:] for r in rows] == [("1", 'x;"y'), ("", "zwei\nZeilen"), ("ž", "")]
    write_csv(df, str(tmp_path / "out"), dialect)
    again, _ = read_csv(spark, str(tmp_path / "out"), dialect)
    assert sorted(tuple(r)[1:] for r in again.collect()) == sorted(r[1:] for r in rows)


def test_comma_dialect(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b\n1,2\n3,4\n")
    assert detect_dialect(spark, str(tmp_path / "c.csv")).delimiter == ","


def test_cache_versions_and_corruption(spark, tmp_path):
    cache = CacheTable(spark, str(tmp_path / "cache"))
    assert cache.load().count() == 0
    row = lambda v, n: spark.createDataFrame([("k", v, n)], "key string, translated string, batch_id long").selectExpr("key", "translated", "timestamp'2024-01-01' as updated_at", "batch_id")
    cache.save(row("a", 1))
    assert [r.translated for r in cache.save(row("b", 2)).collect()] == ["b"]
    (tmp_path / "cache" / "log" / "000000000009.json").write_text("no json")
    assert CacheTable(spark, str(tmp_path / "cache")).load().count() == 0
    assert list((tmp_path / "cache").glob("log.corrupt-*"))


def test_json_import(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"hello": "ahoj"}')
    assert [(r.key, r.translated) for r in import_json(spark, str(tmp_path / "c.json")).collect()] == [("hello", "ahoj")]
    (tmp_path / "bad.json").write_text("{oops")
    assert import_json(spark, str(tmp_path / "bad.json")).count() == 0


def test_payload_shapes():
    assert items_of([{"a": 1}, 2]) == [{"a": 1}]
    assert items_of({"data": {"items": [{"a": 1}]}}) == [{"a": 1}]
    assert items_of({"products": [{"a": 1}]}) == [{"a": 1}] and items_of({"x": 1}) == [] and items_of("x") == []
    assert normal_url("shop.example/") == "https://shop.example"
    with pytest.raises(ValueError):
        normal_url(" ")


@pytest.mark.parametrize("size", [7, 23, 64, 300, 100_000])
def test_quoted_breaks_across_ranges(spark, tmp_path, size):
    """Rows are those of the one-task reader, wherever byte ranges cut the files."""
    long = "\n".join(f"line {i} ""of"" a cell" for i in range(12))
    body = ["h1;h2;h1", 'a;"b";c', '"x\ny";"";z', "", 'p;"q""r\n""""\n";s', f'"{long}";2;3', '"\n\n";;"end\n"', 'ž;"é\nü";last;too many', "short"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text("\ufeff" + "\n".join(body) + "\n", encoding="utf-8")
    (tmp_path / "in" / "two.csv").write_text("h1;h2;h1\r\n" + '1;"2\r\n3";4\r\n5;6;7\r\n', encoding="utf-8", newline="")
    path = f"file://{tmp_path}/in"
    options = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        df, _ = read_csv(spark, path, Dialect())
        found = [tuple(r) for r in df.orderBy("row_index").collect()]
        tasks = spark.read.text(path).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    whole = spark.read.csv(path, header=True, sep=";", quote='"', escape='"', multiLine=True).na.fill("").withColumn("f", F.input_file_name()).coalesce(1)
    want = sorted((r.f, i, tuple(r)[:-1]) for i, r in enumerate(whole.collect()))
    fixed = lambda cells: tuple(c.replace("\r\n", "\n") for c in cells)  # noqa: E731  the one-task reader makes line breaks alike
    assert [fixed(r[1:]) for r in found] == [fixed(w[2]) for w in want]
    assert [r[0] for r in found] == list(range(len(want))) and df.columns == ["row_index", "h10", "h2", "h12"]
    assert size > 100 or tasks > 2


def test_csv_of_one_open_cell(spark, tmp_path):
    (tmp_path / "o.csv").write_text('a;b\n1;"never closed\nand so on\n')
    rows = read_csv(spark, f"file://{tmp_path}/o.csv", Dialect())[0].collect()
    assert len(rows) == 1 and rows[0].a == "1"


class Shop(BaseHTTPRequestHandler):
    paged, patched, asked, products, failing, keys = True, [], [], 5, {}, []

    def reply(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):
        q = parse_qs(urlparse(self.path).query)
        if not Shop.paged:
            return self.reply(400 if q else 200, [{"id": "1", "ean": "a"}])
        page, size = int(q["page"][0]), int(q["limit"][0])
        Shop.asked.append((page, self.client_address))
        ids = range((page - 1) * size, min(Shop.products, page * size))
        self.reply(200, {"data": {"items": [{"id": str(i), "ean": f"e{i}", "more": {"x": i}} for i in ids]}})

    def do_PATCH(self):
        self.rfile.read(int(self.headers["Content-Length"]))
        key = self.path.rsplit("/", 1)[1]
        Shop.patched.append(key)
        Shop.keys.append(self.headers.get("Idempotency-Key"))
        codes = Shop.failing.get(key, [])
        self.reply(codes.pop(0) if codes else 404 if key == "3" else 200, {})

    def log_message(self, *a):
        pass


@pytest.fixture
def shop():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Shop)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Shop.paged, Shop.products = True, 5
    for held in (Shop.patched, Shop.asked, Shop.keys):
        held.clear()
    Shop.failing.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_product_api(spark, shop):
    df = read_products(spark, base_url=shop, page_size="2")
    assert df.count() == 5 and "more.x" in df.columns
    with pytest.raises(Exception, match="max_pages"):
        read_products(spark, base_url=shop, page_size="2", max_pages="2")
    assert read_products(spark, base_url=shop, page_size="2", max_pages="3").count() == 5
    source = spark.createDataFrame([("r0", " e0", "A"), ("r1", "e3", "B"), ("r2", "none", "C"), ("r3", None, "D")], "row_index string, ean string, name string")
    plan = publish_plan(source, df, "ean", "id", ["name"])
    sent = patch_products(plan.where("product_id is not null"), {"base_url": shop, "retries": "0"}).cache()
    assert {(r.row_index, r.ok, r.error_class, r.requests) for r in sent.collect()} == {("r0", True, None, 1), ("r1", False, "final", 1)}
    report = publish_report(plan, sent, None).first()
    assert (report.updated, report.failed, report.missing, report.blocked) == (1, 1, 1, False)
    Shop.paged = False
    assert read_products(spark, base_url=shop).count() == 1


def test_pages_are_read_once_by_several_tasks(spark, shop):
    Shop.products = 5 * 500 - 2  # 500 pages, the last one short
    spark.dataSource.register(ProductSource)
    df = spark.read.format("product_api").options(base_url=shop, page_size="5", max_pages="600", pages_per_task="60").load()
    rows = df.select(F.spark_partition_id().alias("p"), F.get_json_object("value", "$.id").alias("id")).collect()
    assert sorted(int(r.id) for r in rows) == list(range(Shop.products)) and len({r.p for r in rows}) == 9
    # each page once, and of the ranges behind the end their first page only
    assert sorted(p for p, _ in Shop.asked) == [*range(1, 501), 542]


def test_sink_counts_what_the_shop_saw(spark, shop, tmp_path):
    rows = [(f"r{i}", str(i + 10), '{"name":"x"}') for i in range(12)]
    Shop.failing.update({"11": [503, 429], "12": [404], "13": [500] * 9})
    df = spark.createDataFrame(rows, "row_index string, product_id string, payload string").repartition(3)
    options = {"base_url": shop, "retries": "2", "backoff": "0.01", "report": f"file://{tmp_path}/report.json", "journal": f"file://{tmp_path}/journal", "run": "run-1"}
    write_products(df, options)
    told = json.loads((tmp_path / "report.json").read_text())
    assert {k: told[k] for k in ("status", "tasks", "rows", "updated", "retryable", "final", "requests", "errors", "resumed")} == {
        "status": "committed", "tasks": 3, "rows": 12, "updated": 10, "retryable": 1, "final": 1, "requests": len(Shop.patched), "errors": 2, "resumed": 0}
    assert len(Shop.patched) == 12 + 2 + 2 and told["error_ratio"] == 2 / 16 and set(Shop.keys) == {f"run-1/r{i}" for i in range(12)}


def test_a_task_that_runs_again_sends_no_row_twice(shop, tmp_path):
    rows = [Row(row_index=f"r{i}", product_id=str(i + 10), payload="{}") for i in range(6)]
    options = {"base_url": shop, "retries": "0", "journal": f"file://{tmp_path}/journal", "run": "r"}

    def broken():
        yield from rows[:4]
        raise OSError("executor lost")

    with pytest.raises(OSError):
        ProductSource(options).writer(None, False).write(broken())
    with open(tmp_path / "journal" / "task-0.jsonl", "a") as f:
        f.write('["r4", "upda')  # a note that was broken off
    sent = ProductSource(options).writer(None, False).write(iter(rows))
    assert sent == Sent(rows=6, updated=6, resumed=4, requests=2, errors=0, latency_ms=sent.latency_ms)
    assert Shop.patched == [str(i + 10) for i in range(6)]


def test_error_classes_and_client_metrics(shop):
    client = Client({"base_url": shop, "retries": "1", "backoff": "0.01"})
    Shop.failing.update({"7": [503, 503], "8": [503]})
    with pytest.raises(RetryableApiError) as e:
        client.call("PATCH", "products/7", body={})
    assert e.value.status == 503
    with pytest.raises(ApiError) as e:
        client.call("PATCH", "products/3", body={})
    assert e.value.kind == "final" and e.value.status == 404
    client.call("PATCH", "products/8", body={})
    found = client.metrics()
    assert (found["requests"], found["errors"], found["error_ratio"]) == (5, 2, 0.4) and found["avg_latency_ms"] >= 0
    lost = Client({"base_url": "http://127.0.0.1:9", "retries": "0"})
    with pytest.raises(RetryableApiError):
        lost.call("GET", "products")
    assert lost.metrics()["error_ratio"] == 1 and Client({"base_url": "x"}).metrics()["error_ratio"] == 0


def test_missing_columns(spark):
    with pytest.raises(ValueError):
        publish_plan(spark.range(1), spark.range(1), "ean", "id", [])


def test_breaker(spark):
    df = spark.createDataFrame([(i, i in (3, 4, 5)) for i in range(10)], "o long, f boolean")
    assert [r.breach for r in blocked_from(df, "o", "f", 0.4).collect()] == [5]
    assert blocked_from(df, "o", "f", 0.9).collect() == []
