"""A paginated product API as a Python data source, and a keyed sink that patches products."""

from __future__ import annotations

import contextlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from typing import Any

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .scratch import shared_folder
from .tables import flatten

# Answers that are tried again, and the names under which payloads keep their lists.
RETRIED = (429, 500, 502, 503, 504)
OUTER, INNER = ("data", "items", "results", "products"), ("items", "results", "products")


def normal_url(base: str) -> str:
    base = base.strip()
    if not base:
        raise ValueError("base URL is empty")
    return (base if "://" in base else f"https://{base}").rstrip("/")


def items_of(payload: Any) -> list[dict]:
    """Objects of a payload: a list itself, the first list under a known name, or one inside such an object."""
    dicts = lambda rows: [x for x in rows if isinstance(x, dict)]
    if isinstance(payload, list):
        return dicts(payload)
    if not isinstance(payload, dict):
        return []

    def candidates():
        for value in map(payload.get, OUTER):
            yield value
            if isinstance(value, dict):
                yield from map(value.get, INNER)

    return next((dicts(x) for x in candidates() if isinstance(x, list)), [])


class ApiError(RuntimeError):
    """An answer that trying again does not mend."""

    kind = "final"

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class RetryableApiError(ApiError):
    """An answer or a broken connection that another try might have mended, had there been more."""

    kind = "retryable"


class Client:
    """Requests with bearer token, bounded retries and counters of requests, errors and milliseconds."""

    def __init__(self, options: dict[str, str]):
        self.base = normal_url(options["base_url"])
        self.token = options.get("token", "")
        self.timeout, self.retries, self.backoff = float(options.get("timeout", 30)), int(options.get("retries", 3)), float(options.get("backoff", 0.5))
        self.requests = self.errors = self.latency_ms = 0

    def _once(self, method: str, url: str, data: bytes | None, headers: dict[str, str]) -> Any:
        self.requests += 1
        began = time.monotonic()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers, method=method), timeout=self.timeout) as answer:
                return json.loads(answer.read() or b"null")
        except urllib.error.HTTPError as e:
            raise (RetryableApiError if e.code in RETRIED else ApiError)(f"HTTP {e.code}", e.code) from e
        except OSError as e:
            raise RetryableApiError(str(e)) from e
        finally:
            self.latency_ms += int(1000 * (time.monotonic() - began))

    def call(self, method: str, path: str, params: dict | None = None, body: Any = None, key: str | None = None) -> Any:
        """The payload; ``key`` lets the other side tell a repeated request."""
        url = f"{self.base}/{path.lstrip('/')}" + (f"?{urllib.parse.urlencode(params)}" if params else "")
        headers = {"Authorization": f"Bearer {self.token}", "Content-Type": "application/json"} | ({"Idempotency-Key": key} if key else {})
        for attempt in range(self.retries + 1):
            try:
                return self._once(method, url, None if body is None else json.dumps(body).encode(), headers)
            except ApiError as e:
                if not isinstance(e, RetryableApiError) or attempt == self.retries:
                    self.errors += 1
                    raise
            time.sleep(self.backoff * 2**attempt)
        raise AssertionError

    def metrics(self) -> dict[str, float]:
        n = max(1, self.requests)
        return {"requests": self.requests, "errors": self.errors, "error_ratio": self.errors / n, "avg_latency_ms": self.latency_ms / n}


class _Pages(InputPartition):
    """Pages first to last, behind rows that planning has already fetched."""

    def __init__(self, first: int, last: int, rows: list[str]):
        self.first, self.last, self.rows = first, last, rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = o = dict(options)
        self.size, self.path, self.most = int(o.get("page_size", 100)), o.get("endpoint", "products"), int(o.get("max_pages", 100))
        self.names = o.get("page_param", "page"), o.get("limit_param", "limit")

    def _page(self, client: Client, page: int) -> list[str] | None:
        """Rows of a page; none where the API knows no such page."""
        try:
            payload = client.call("GET", self.path, {self.names[0]: page, self.names[1]: self.size})
        except ApiError as e:
            if e.status == 400:
                return None
            raise
        return [json.dumps(row, ensure_ascii=False) for row in items_of(payload)]

    def partitions(self) -> list[InputPartition]:
        """The first page tells whether there are pages at all, and more of them: then ranges of pages are dealt out."""
        client = Client(self.options)
        rows = self._page(client, 1)
        if rows is None:  # an API without pages
            return [_Pages(1, 0, [json.dumps(row, ensure_ascii=False) for row in items_of(client.call("GET", self.path))])]
        if len(rows) < self.size:
            return [_Pages(1, 0, rows)]
        each = max(1, int(self.options.get("pages_per_task", 25)))
        cuts = list(range(2, self.most + 1, each)) or [2]
        return [_Pages(lo, min(self.most, lo + each - 1), rows if lo == 2 else []) for lo in cuts]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        yield from ((row,) for row in partition.rows)
        client = Client(self.options)
        for page in range(partition.first, partition.last + 1):
            rows = self._page(client, page)
            yield from ((row,) for row in rows or [])
            if not rows or len(rows) < self.size:
                return
        if partition.first > 1 and partition.last >= self.most:
            # the last page that is allowed was full, so products may be missing
            raise RuntimeError(f"products do not end within {self.most} pages of {self.size}: set max_pages or page_size higher")


@dataclass
class Sent(WriterCommitMessage):
    """What a task has sent: rows, those whose update went through, those that an earlier try of the task had sent, errors by class, requests, time."""

    rows: int = 0
    updated: int = 0
    resumed: int = 0
    retryable: int = 0
    final: int = 0
    requests: int = 0
    errors: int = 0
    latency_ms: int = 0


def _open_journal(options: dict[str, str], partition: int) -> tuple[dict[str, str], Callable[[str, str], None]]:
    """Rows that earlier tries of a task have sent, with what came of them, and a function that notes one more at once."""
    if not options.get("journal"):
        return {}, lambda row, what: None
    fs, folder = pafs.FileSystem.from_uri(options["journal"])
    fs.create_dir(folder, recursive=True)
    path, known = f"{folder}/task-{partition}.jsonl", {}
    if fs.get_file_info(path).type == pafs.FileType.File:
        with fs.open_input_stream(path) as f:
            for line in f.read().decode().splitlines():
                with contextlib.suppress(ValueError):  # the end of a line that was broken off
                    row, what = json.loads(line)
                    known[row] = what

    def note(row: str, what: str) -> None:
        with fs.open_append_stream(path) as f:
            f.write((json.dumps([row, what]) + "\n").encode())

    return known, note


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def write(self, rows: Iterator[Row]) -> Sent:
        context = TaskContext.get()
        client, sent, path = Client(self.options), Sent(), self.options.get("endpoint", "products")
        known, note = _open_journal(self.options, context.partitionId() if context else 0)
        for r in rows:
            sent.rows += 1
            what = known.get(r.row_index)
            if what is None:
                try:
                    client.call("PATCH", f"{path}/{urllib.parse.quote(r.product_id, safe='')}", body=json.loads(r.payload), key=f"{self.options.get('run', '')}/{r.row_index}")
                    what = "updated"
                except ApiError as e:
                    what = e.kind
                note(r.row_index, what)
            else:
                sent.resumed += 1
            setattr(sent, what, getattr(sent, what) + 1)
        sent.requests, sent.errors, sent.latency_ms = client.requests, client.errors, client.latency_ms
        return sent

    def commit(self, messages: list[Sent | None]) -> None:
        self._report("committed", messages)

    def abort(self, messages: list[Sent | None]) -> None:
        self._report("aborted", messages)

    def _report(self, status: str, messages: list[Sent | None]) -> None:
        """Sums over tasks as one JSON line in ``report``: each task's last try counts once, however often it ran."""
        if path := self.options.get("report"):
            done = [m for m in messages if m is not None]
            sums = {f.name: sum(getattr(m, f.name) for m in done) for f in fields(Sent)}
            n = max(1, sums["requests"])
            line = {"status": status, "tasks": len(done), **sums, "error_ratio": sums["errors"] / n, "avg_latency_ms": sums["latency_ms"] / n}
            fs, where = pafs.FileSystem.from_uri(path)
            fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(where) as f:
                f.write((json.dumps(line) + "\n").encode())


class ProductSource(DataSource):
    """Products of a REST API: read as JSON strings, page by page, or patched by key.

    Reading: base_url, token, endpoint, page_size, max_pages, pages_per_task, page_param, limit_param.  Planning fetches the
    first page; ranges of ``pages_per_task`` pages are then read by tasks, each of which ends at its first page that is
    not full.  A source whose last allowed page is full fails rather than lose what comes behind it.

    Writing rows (row_index, product_id, payload), mode append: one PATCH each.  ``journal`` names a folder that takes down what
    was sent, so a task that runs again goes on behind it; ``run`` is part of each request's Idempotency-Key, which covers
    the moment between a request and its note.  ``report`` names a file for the sums of all tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "product_api"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def read_products(spark: SparkSession, **options: str) -> DataFrame:
    """Products with nested fields flattened to dotted names; no products, no columns.

    Every page is fetched once: products are kept as lines in the shared folder, and columns follow from these.
    """
    spark.dataSource.register(ProductSource)
    path = f"{shared_folder(spark)}/products-{uuid.uuid4().hex}"
    spark.read.format("product_api").options(**options).load().write.text(path)
    return flatten(spark.read.json(path))


def patch_products(changes: DataFrame, options: dict[str, str]) -> DataFrame:
    """(row_index, product_id, ok, message, error_class, requests, latency_ms) after one PATCH for each row (row_index, product_id, payload).

    Repeating a row repeats the same change under the same key, so a task may run again.
    """

    def send(frames):
        client = Client(options)
        for f in frames:
            out = []
            for row, key, payload in zip(f["row_index"], f["product_id"], f["payload"], strict=True):
                before = client.requests, client.latency_ms
                kind = message = None
                try:
                    client.call("PATCH", f"{options.get('endpoint', 'products')}/{urllib.parse.quote(key, safe='')}", body=json.loads(payload), key=f"{options.get('run', '')}/{row}")
                except ApiError as e:
                    kind, message = e.kind, str(e)
                out.append((kind is None, message or "", kind, client.requests - before[0], client.latency_ms - before[1]))
            cols = dict(zip(("ok", "message", "error_class", "requests", "latency_ms"), zip(*out, strict=True), strict=True)) if out else {}
            yield f[["row_index", "product_id"]].assign(**cols)

    fields_ = "row_index string, product_id string, ok boolean, message string, error_class string, requests long, latency_ms long"
    return changes.select("row_index", "product_id", "payload").mapInPandas(send, fields_)


def write_products(changes: DataFrame, options: dict[str, str]) -> None:
    """PATCH all rows (row_index, product_id, payload) through the sink."""
    changes.sparkSession.dataSource.register(ProductSource)
    changes.select("row_index", "product_id", "payload").write.format("product_api").options(**options).mode("append").save()
