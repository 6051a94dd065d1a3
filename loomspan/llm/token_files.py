"""Token ids in files of directly addressable codes.

Each folder ``bucket=k`` holds one range of doc_ids, in one file sorted by doc_id; ranges ascend with k.
A file row is one document: its doc_id and ``codes``, stored plainly, neither compressed nor in a
dictionary, so that a reader of one token decodes nothing else.  Codes split each id into chunks of eight bits.  Level k holds the k-th chunk of every id that has one, a bitmap
that tells which of them go on, and a rank directory with the number of set bits before each block of
512.  Any id is found from its place by one rank a level, without decoding others.

Layout of ``codes``: level count (u32); ids in each level (u32 each); then for each level its chunk
bytes, and for each level but the last its bitmap (little bit order) and directory (u32 each).
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder
from .workspace import Workspace, partitions_for, tidy

BLOCK = 512


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    sizes, parts = [], []
    while True:
        sizes.append(len(ids))
        parts.append(ids.astype(np.uint8).tobytes())
        more = ids > 255
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32)
        parts += [bits.tobytes(), np.append(np.uint32(0), np.cumsum(ones[:-1], dtype=np.uint32)).astype(np.uint32).tobytes()]
        ids = ids[more] >> np.uint32(8)
    return np.array([len(sizes), *sizes], np.uint32).tobytes() + b"".join(parts)


def _levels(codes: bytes) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
    count = int.from_bytes(codes[:4], "little")
    sizes = np.frombuffer(codes, np.uint32, count, 4).tolist()
    at = 4 + 4 * count
    for k, n in enumerate(sizes):
        chunks = np.frombuffer(codes, np.uint8, n, at)
        at += n
        if k == count - 1:
            yield chunks, None, None
            return
        bits, blocks = -(-n // 8), -(-n // BLOCK)
        yield chunks, np.frombuffer(codes, np.uint8, bits, at), np.frombuffer(codes[at + bits : at + bits + 4 * blocks], np.uint32)
        at += bits + 4 * blocks


def unpack(codes: bytes) -> np.ndarray:
    """All ids."""
    levels = list(_levels(codes))
    ids = levels[-1][0].astype(np.uint32)
    for chunks, bits, _ in reversed(levels[:-1]):
        whole = chunks.astype(np.uint32)
        whole[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= ids << np.uint32(8)
        ids = whole
    return ids


def token_count(codes: bytes) -> int:
    return int.from_bytes(codes[4:8], "little")


def token_at(codes: bytes, place: int) -> int:
    """The id at a place, by one rank a level."""
    out = 0
    for k, (chunks, bits, ranks) in enumerate(_levels(codes)):
        out |= int(chunks[place]) << (8 * k)
        if bits is None or not bits[place >> 3] >> (place & 7) & 1:
            return out
        block = place // BLOCK
        head = bits[block * BLOCK // 8 : place >> 3]
        place = int(ranks[block]) + int(np.bitwise_count(head).sum()) + int.bit_count(int(bits[place >> 3]) & ((1 << (place & 7)) - 1))
    raise IndexError(place)


@dataclass
class _Ranges:
    """Buckets of ascending doc_ids: where each range begins, its first bucket, and over how many its rows are spread."""

    starts: list
    first: list[int]
    spread: list[int]
    nulls: int

    def bucket(self, key, tie: int) -> int:
        """Rows of one doc_id that are too many for a file are spread by ``tie``, in its order."""
        if key is None:
            return tie * self.nulls >> 32
        i = max(0, bisect_right(self.starts, key) - 1)
        return self.first[i] + (tie * self.spread[i] >> 32)


def _ranges(docs: DataFrame, rows_per_file: int) -> tuple[_Ranges, int]:
    """Ranges of about ``rows_per_file`` rows by a range partitioning of the ids alone, and the number of buckets."""
    spark = docs.sparkSession
    parts = partitions_for(spark, docs.count(), rows_per_file)
    placed = docs.select("doc_id", F.lit(0).alias("one")).repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id())
    nulls = F.count_if(F.col("doc_id").isNull())
    found = placed.groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("doc_id").alias("n"), nulls.alias("nulls")).orderBy("part").collect()  # a row a file
    many = lambda n: max(1, -(-n // rows_per_file))
    empty = many(sum(r.nulls for r in found))
    own = [r for r in found if r.n]
    spread = [many(r.n) if r.a == r.b else 1 for r in own]
    first = [empty + sum(spread[:i]) for i in range(len(own))]
    return _Ranges([r.a for r in own], first, spread, empty), empty + sum(spread)


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = 2, rows_per_file: int = 200_000) -> None:
    """Encode every whole text, append ``end_id`` and write codes in ascending doc_id order.

    Each text is encoded once and dealt straight to the file of its doc_id; rows within a file are
    sorted.  Equal doc_ids, of any type that Spark can sort, are ordered by the checksum of their ids,
    and spread over several files by it if they are too many for one.  A null text is an empty one;
    rows without doc_id come first.  No rows give an empty table.  Other columns are ignored.
    """
    ranges, buckets = _ranges(docs, rows_per_file)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            keys, codes, sums = batch["doc_id"], [], []
            for ids in enc.encode_column(batch["text"]):
                raw = ids + end
                codes.append(pack(np.frombuffer(raw, np.uint32)))
                sums.append(zlib.crc32(raw))
            bucket = [ranges.bucket(k, t) for k, t in zip(keys.to_pylist(), sums, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), keys, pa.array(sums, pa.int64()), pa.array(codes, pa.binary())], ["bucket", "doc_id", "tie", "codes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = docs.select("doc_id", "text").mapInArrow(tidy(encode), f"bucket int, doc_id {kind}, tie long, codes binary")
    dealt = coded.repartition(buckets, "bucket").sortWithinPartitions("bucket", "doc_id", "tie")
    plain = dealt.write.option("compression", "none").option("parquet.enable.dictionary", "false")
    plain.partitionBy("bucket").parquet(f"{out}/ids")
    spark = docs.sparkSession
    # an empty table has no folders, hence no columns to be found
    spark.createDataFrame([(kind,)], "doc_id string").write.mode("overwrite").json(f"{out}/kind")
    places = list(zip(ranges.starts, ranges.first, ranges.spread, strict=True))
    spark.createDataFrame(places, f"start {kind}, bucket int, files int").coalesce(1).write.mode("overwrite").parquet(f"{out}/ranges")  # a row a range


def open_token_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, tie, codes, bucket) of the files."""
    kind = spark.read.schema("doc_id string").json(f"{out}/kind").first().doc_id
    return spark.read.schema(f"doc_id {kind}, tie long, codes binary, bucket int").parquet(f"{out}/ids")


def files_of(spark: SparkSession, out: str, ids: list) -> DataFrame:
    """(doc_id, codes) of some documents: only the files whose ranges have these ids are opened, and of them only the pages that do."""
    found = spark.read.parquet(f"{out}/ranges").orderBy("start", "bucket").collect()  # a row a range
    starts, buckets = [r.start for r in found], set()
    for i in ids:
        k = max(0, bisect_right(starts, i) - 1)
        if found:
            buckets.update(range(found[k].bucket, found[k].bucket + found[k].files))
    files = open_token_files(spark, out)
    return files.where(F.col("bucket").isin(sorted(buckets)) & F.col("doc_id").isin(ids)).select("doc_id", "codes")


def tokens_at(spark: SparkSession, out: str, wanted: DataFrame, most: int = 10_000) -> DataFrame:
    """(doc_id, place, id) of single tokens: each row of ``wanted`` (doc_id, place) with the id at that place.

    Up to ``most`` different documents are looked up by their files' ranges of doc_id and sent to the rows that ask;
    more are joined, which reads all files.  Of each document only the bytes on the way to its token are decoded.
    A place past the end gives null; so does a document that is not there.
    """
    few = [r.doc_id for r in wanted.select("doc_id").where("doc_id is not null").distinct().limit(most + 1).collect()]
    files = files_of(spark, out, few) if len(few) <= most else open_token_files(spark, out).select("doc_id", "codes")
    kind = open_token_files(spark, out).schema["doc_id"].dataType.simpleString()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for codes, place in zip(batch["codes"], batch["place"].to_pylist(), strict=True):
                raw = codes.as_py()
                ids.append(token_at(raw, place) if raw is not None and 0 <= place < token_count(raw) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["place"], pa.array(ids, pa.int64())], ["doc_id", "place", "id"])

    found = wanted.select("doc_id", F.col("place").cast("long")).join(files, "doc_id", "left")
    return found.select("doc_id", "place", "codes").mapInArrow(pick, f"doc_id {kind}, place long, id long")


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts all ids of documents before it."""
    ws = Workspace(spark, "token_index")
    files = open_token_files(spark, out)
    kind = files.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [unpack(c) for c in batch["codes"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(map(len, ids), pa.int64()), pa.array((zlib.crc32(x) for x in ids), pa.int64())], ["bucket", "doc_id", "tie", "n_tokens", "ids_crc32"])

    slim = ws.save(files.select("bucket", "doc_id", "tie", "codes").mapInArrow(tidy(measure), f"bucket int, doc_id {kind}, tie long, n_tokens long, ids_crc32 long"), "slim")
    before, total = [], 0
    for r in slim.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).orderBy("bucket").collect():  # one row a file
        before.append((r.bucket, total))
        total += r.n
    offsets = F.broadcast(spark.createDataFrame(before, "bucket int, ids_before long"))
    w = Window.partitionBy("bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ids_before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0))
    return slim.join(offsets, "bucket").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
