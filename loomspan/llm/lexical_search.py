"""Ranked lexical search over a two-level index: byte impacts for bounds, exact integers for scores.

The index is a table of blocks.  Each holds some thousand documents: a vocabulary, for each term its
documents in the block, and on two levels what the term is worth there.  The first level is one byte, the
impact divided by ``STEP`` and rounded up, so a score is at most the sum of the bytes times STEP, and at
least what is left if each is one step less.  The second level is exact: occurrences, and the lengths of
documents.  A search reads the first level, finds for each item the k-th greatest lower bound, and
rescores every document whose upper bound reaches it; no other can be among the k best.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace, tidy

#: An impact is SCALE * tf div (1000 * tf + 8 * m), with m = 100 - SLOPE + (SLOPE * n * N) div L.
SCALE, SLOPE = 1_000_000_000, 75
#: Greatest impacts are below SCALE / 1000, so one byte holds an impact in steps of this.
STEP = -(-(SCALE // 1000) // 255)
#: Bytes of text, and documents, of a block.
BLOCK_BYTES, BLOCK_DOCS = 8_000_000, 30_000
#: A row group for each block.  Spark reads a row group at a time and would hold all blocks of a task as often as it copies them.
_APART = {"parquet.block.row.count.limit": "1"}
#: Bytes that stay as they are in a term, upper case lowered; all others separate terms.
_TERM = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Terms of a text in order, with repeats, A-Z lower-cased."""
    return text.encode().translate(_TERM).split()


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What an occurrence count is worth in documents of n terms, for ``docs`` documents of ``total`` terms."""
    tf, n = tf.astype(np.int64), n.astype(np.int64)
    wide = int(n.max(initial=0)) * docs * SLOPE >= 1 << 63
    m = 100 - SLOPE + (np.array([SLOPE * x * docs // total for x in n.tolist()], np.int64) if wide else SLOPE * n * docs // max(1, total))
    return SCALE * tf // (1000 * tf + 8 * m)


def weight(docs: int, df: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class _Block:
    """Documents of a block as they come."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.sizes, self.terms, self.tfs = [], [], [], []
        self.n_terms, self.bytes = [], 0

    def add(self, doc_id, text: str) -> None:
        found = Counter(terms(text))
        number = self.vocabulary
        self.terms += [number.setdefault(t, len(number)) for t in found]
        self.tfs += found.values()
        self.sizes.append(len(found))
        self.n_terms.append(sum(found.values()))
        self.ids.append(doc_id)
        self.bytes += len(text)

    def row(self) -> dict:
        term, tf = np.array(self.terms, np.int64), np.array(self.tfs, np.uint32)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.sizes)
        order = np.argsort(term, kind="stable")
        counts = np.bincount(term, minlength=len(self.vocabulary)).astype(np.uint32)
        return {"docs": sum(n > 0 for n in self.n_terms), "total": sum(self.n_terms), "doc_ids": self.ids, "terms": [t.decode() for t in self.vocabulary],
                "df": counts.tobytes(), "places": doc[order].tobytes(), "tf": tf[order].tobytes(), "n_terms": np.array(self.n_terms, np.uint32).tobytes()}


_FIRST = "docs long, total long, doc_ids array<long>, terms array<string>, df binary, places binary, tf binary, n_terms binary"
_KINDS = {"docs": pa.int64(), "total": pa.int64(), "doc_ids": pa.list_(pa.int64()), "terms": pa.list_(pa.string())}


def _record(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], _KINDS.get(k, pa.binary())) for k, v in row.items()], list(row))


def write_index(docs: DataFrame, out: str, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> None:
    """Index all rows of ``docs`` (doc_id long, text) in the folder ``out``.

    Texts are read once.  Levels are written when the numbers of documents and terms are known.  A null or empty
    text has no terms; it is indexed and never found.  Repeated rows are documents of their own.
    """
    spark = docs.sparkSession

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for key, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                block.add(key, text.as_py() or "")
                if block.bytes >= block_bytes or len(block.ids) >= block_docs:
                    yield _record(block.row())
                    block = _Block()
        if block.ids:
            yield _record(block.row())

    ws = Workspace(spark, "blocks")
    blocks = ws.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(build), _FIRST), "blocks", **_APART)
    sums = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    n_docs, total = sums.docs, sums.total

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                places, tf, n = (np.frombuffer(row[c], np.uint32) for c in ("places", "tf", "n_terms"))
                exact = impacts(tf, n[places], n_docs, total)
                yield _record({**row, "bytes": (-(-exact // STEP)).astype(np.uint8).tobytes()})

    blocks.mapInArrow(tidy(level), _FIRST + ", bytes binary").write.options(compression="zstd", **_APART).parquet(f"{out}/blocks")
    spark.createDataFrame([(n_docs, total)], "docs long, total long").write.json(f"{out}/sums")
    ws.drop("blocks")


@dataclass
class _Items:
    """A batch of items: their different terms, and of each item the numbers and repeats of its terms."""

    keys: list[int]
    words: list[str]
    asked: list[list[tuple[int, int]]]


def _items(rows: list) -> _Items:
    words: dict[str, int] = {}
    asked = [[(words.setdefault(t.decode(), len(words)), n) for t, n in Counter(terms(r.text or "")).items()] for r in rows]
    return _Items([r["__item"] for r in rows], list(words), asked)


def _best(rows: DataFrame, keys: list[str], order: list, k: int, salts: int = 64) -> DataFrame:
    """The first k rows of each ``keys`` in ``order``: among random parts first, so that no task sorts all of an item's rows."""
    for part in ([F.pmod(F.xxhash64("block"), F.lit(salts))], []):
        w = Window.partitionBy(*keys, *part).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return rows


def search(spark: SparkSession, out: str, items: DataFrame, k: int = 10, batch: int = 1000) -> DataFrame:
    """(items' columns but text, rank, doc_id, score): the k best documents of each row of ``items`` (text and any keys).

    Items are asked in batches of about ``batch``, each in three passes over the index: document frequencies of the
    batch's terms, bounds, exact scores.  What a pass gives for an item is k rows a block at most.  Only
    scores above 0 count; equal scores are ranked by ascending doc_id, rows without doc_id last.  A term that no
    document has, a null text and an empty one find nothing.  Repeated items are answered each.
    """
    ws = Workspace(spark, "search")
    keys = [c for c in items.columns if c != "text"]
    asked = ws.save(items.withColumn("__item", F.monotonically_increasing_id()), "items")
    several = max(1, -(-asked.count() // batch))
    sums = spark.read.schema("docs long, total long").json(f"{out}/sums").first()
    kinds = _FIRST.replace("docs long, total long, ", "") + ", bytes binary"
    index = spark.read.schema(kinds).parquet(f"{out}/blocks")
    found = []
    for part in range(several):
        rows = asked.where(F.expr(f"pmod(xxhash64(__item), {several})") == part).select("__item", "text").collect()  # a batch
        found.append(ws.save(_answers(spark, index, _items(rows), sums.docs, sums.total, k), f"found{part}"))
    answers = found[0]
    for more in found[1:]:
        answers = answers.unionByName(more)
    joined = asked.drop("text").join(answers, "__item")
    return joined.select(*keys, F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _answers(spark: SparkSession, index: DataFrame, items: _Items, docs: int, total: int, k: int) -> DataFrame:
    """(__item, rank, doc_id, score) of a batch of items."""
    words = pa.array(items.words, pa.string())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for vocabulary, df in zip(b["terms"], b["df"], strict=True):
                at = pc.index_in(words, value_set=vocabulary.values)
                have = np.flatnonzero(at.is_valid())
                n = np.frombuffer(df.as_py(), np.uint32)[at.drop_null().to_numpy()].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(n)], ["word", "df"])

    counted = index.select("terms", "df").mapInArrow(tidy(frequencies), "word int, df long").groupBy("word").agg(F.sum("df").alias("df"))
    weights = {r.word: weight(docs, r.df) for r in counted.collect()}  # of the batch's terms
    asked = [[(w, weights[w] * n) for w, n in own if weights.get(w)] for own in items.asked]

    def postings(vocabulary: pa.Scalar, df: bytes) -> list[slice | None]:
        at = pc.index_in(words, value_set=vocabulary.values).to_pylist()
        ends = np.cumsum(np.frombuffer(df, np.uint32).astype(np.int64))
        return [None if i is None else slice(int(ends[i - 1]) if i else 0, int(ends[i])) for i in at]

    def bounds(own: list[tuple[int, int]], slices: list[slice | None], places: np.ndarray, impact: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all documents of a block the least and the greatest score."""
        most, gap = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for w, value in own:
            if slices[w] is not None:
                at, level = places[slices[w]], impact[slices[w]]
                most[at] += value * STEP * level
                gap[at] += value * (STEP - 1) * (level > 0)
        return most - gap, most

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for vocabulary, df, ids, raw, level in zip(*(b[c] for c in ("terms", "df", "doc_ids", "places", "bytes")), strict=True):
                slices, n = postings(vocabulary, df.as_py()), len(ids)
                places, impact = np.frombuffer(raw.as_py(), np.uint32), np.frombuffer(level.as_py(), np.uint8).astype(np.int64)
                item, value = [], []
                for i, own in enumerate(asked):
                    least, _ = bounds(own, slices, places, impact, n)
                    best = np.sort(np.partition(least, n - k)[n - k :] if n > k else least)
                    best = best[best > 0]
                    item += [i] * len(best)
                    value += best.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(value, pa.int64()), pa.array([crc32(df.as_py())] * len(item), pa.int64())], ["item", "least", "block"])

    first = index.select("terms", "df", "doc_ids", "places", "bytes")
    least = _best(first.mapInArrow(tidy(lower), "item int, least long, block long"), ["item"], [F.desc("least")], k)
    edges = {r.item: r.least for r in least.where(F.col("rank") == k).select("item", "least").collect()}  # a row an item of the batch

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for vocabulary, df, ids, raw, level, tfs, sizes in zip(*(b[c] for c in ("terms", "df", "doc_ids", "places", "bytes", "tf", "n_terms")), strict=True):
                slices, n = postings(vocabulary, df.as_py()), len(ids)
                places, impact = np.frombuffer(raw.as_py(), np.uint32), np.frombuffer(level.as_py(), np.uint8).astype(np.int64)
                tf, length = np.frombuffer(tfs.as_py(), np.uint32), np.frombuffer(sizes.as_py(), np.uint32)
                keys = ids.values.to_numpy(zero_copy_only=False) if not ids.values.null_count else np.array([np.inf if x is None else x for x in ids.as_py()], object)
                out: list[tuple[int, int | None, int]] = []
                for i, own in enumerate(asked):
                    _, most = bounds(own, slices, places, impact, n)
                    chosen = np.flatnonzero(most >= max(1, edges.get(i, 1)))
                    if not len(chosen):
                        continue
                    where = np.full(n, -1)
                    where[chosen] = np.arange(len(chosen))
                    score = np.zeros(len(chosen), np.int64)
                    for w, value in own:
                        if slices[w] is not None:
                            at = places[slices[w]]
                            mine = np.flatnonzero(where[at] >= 0)
                            at = at[mine]
                            score[where[at]] += value * impacts(tf[slices[w]][mine], length[at], docs, total)
                    order = np.lexsort((keys[chosen], -score))[:k] if keys.dtype != object else np.array(sorted(range(len(chosen)), key=lambda j: (-score[j], keys[chosen[j]]))[:k])
                    out += [(i, None if keys[chosen[j]] == np.inf else int(keys[chosen[j]]), int(score[j])) for j in order if score[j] > 0]
                cols = list(zip(*out, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([crc32(df.as_py())] * len(out), pa.int64())], ["item", "doc_id", "score", "block"])

    best = _best(index.mapInArrow(tidy(scored), "item int, doc_id long, score long, block long"), ["item"], [F.desc("score"), F.col("doc_id").asc_nulls_last()], k)
    numbers = spark.createDataFrame(list(enumerate(items.keys)) or [(-1, -1)], "item int, __item long")
    return best.join(F.broadcast(numbers), "item").select("__item", "rank", "doc_id", "score")
