"""Best-fit packing of documents' ids into sequences, planned on the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import encoder
from .workspace import Workspace, tidy

Plan = list[tuple[tuple[int, ...], int]]


class _Sums:
    """Which sums one, two and three available lengths make, and for each sum a combination that made it.

    Sums go up to the capacity, so the index is addressed by the sum itself: three bit sets say which
    sums exist, and ``found`` keeps the combination last used for a sum, good until a length runs out.
    """

    def __init__(self, counts: list[int]):
        self.counts = counts
        self.singles = sum(1 << n for n, k in enumerate(counts) if k)
        self.pairs = self.triples = 0
        self.found: dict[int, tuple[int, ...]] = {}
        self.stale = True

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for n in lengths:
            self.counts[n] -= times
            if not self.counts[n]:
                self.singles &= ~(1 << n)
                self.stale = True

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(self.counts[n] // lengths.count(n) for n in set(lengths))

    def _index(self) -> None:
        some = [n for n, k in enumerate(self.counts) if k]
        mask = (1 << len(self.counts)) - 1
        self.pairs = self.triples = 0
        for n in some:
            self.pairs |= self.singles << n & mask
        for n in some:
            self.triples |= self.pairs << n & mask
        self.stale = False

    def pair(self, gap: int, beside: tuple[int, ...]) -> tuple[int, int] | None:
        for a in range(gap - 1, (gap - 1) // 2, -1):
            if self.counts[a] and self.counts[gap - a] and self.times((*beside, a, gap - a)):
                return a, gap - a
        return None

    def combination(self, length: int, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that fill the gap beside ``length`` exactly."""
        if self.counts[gap] and self.times((length, gap)):
            return (gap,)
        known = self.found.get(gap)
        if known and self.times((length, *known)):
            return known
        if self.stale:
            self._index()
        new = None
        if self.pairs >> gap & 1:
            new = self.pair(gap, (length,))
        if new is None and self.triples >> gap & 1:
            for a in range(gap - 2, 0, -1):
                if self.counts[a] and self.pairs >> (gap - a) & 1 and (two := self.pair(gap - a, (length, a))):
                    new = (a, *two)
                    break
        if new:
            self.found[gap] = new
        return new


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    """(lengths in one sequence, how many such sequences) for a histogram of piece lengths.

    From long to short, each length is completed by a single, pair or triple of available lengths that
    fills its gap exactly, as often as availability allows.  What is left goes best-fit, long first,
    into the tightest open gap.  Work and result depend on ``capacity``, not on the number of pieces.
    """
    counts = [0] * (capacity + 1)
    for n, k in histogram.items():
        counts[n] = k
    sums, plan = _Sums(counts), []
    if counts[capacity]:
        plan.append(((capacity,), counts[capacity]))
        sums.take((capacity,), counts[capacity])
    for n in range(capacity - 1, 0, -1):
        while counts[n] and (rest := sums.combination(n, capacity - n)):
            times = sums.times((n, *rest))
            plan.append(((n, *rest), times))
            sums.take((n, *rest), times)
    open_: dict[int, list[list]] = defaultdict(list)  # gap -> [lengths, how many]
    for n in range(capacity, 0, -1):
        left = counts[n]
        while left:
            gap = min((g for g, b in open_.items() if b and g >= n), default=None)
            if gap is None:
                each = min(capacity // n, left)
                times = left // each
                open_[capacity - n * each].append([(n,) * each, times])
                left -= each * times
                continue
            lengths, have = open_[gap].pop()
            times = min(have, left)
            if have > times:
                open_[gap].append([lengths, have - times])
            open_[gap - n].append([(*lengths, n), times])
            left -= times
    return plan + [(tuple(lengths), times) for bins in open_.values() for lengths, times in bins]


def _seats(plan: Plan) -> dict[str, np.ndarray]:
    """Runs of seats, by length and then number: where each run starts, its first sequence and its offset."""
    runs, sequence = [], 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            runs.append((n, times, sequence, offset))
            offset += n
        sequence += times
    runs.sort(key=lambda r: r[0])
    n, times, first, offset = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 4
    start = np.cumsum(times) - times
    bases = np.zeros(int(n.max()) + 2 if len(n) else 1, np.int64)
    if len(n):
        bases[:] = np.searchsorted(n, np.arange(len(bases)))
        bases = np.append(start, times.sum())[bases]
    return {"start": start, "sequence": first, "offset": offset, "base": bases}


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut only if too long."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.uint32(end_id).tobytes()
        for batch in batches:
            rows = []
            for key, ids in zip(batch["doc_id"].to_pylist(), enc.encode_column(batch["text"]), strict=True):
                raw = ids + end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch["doc_id"].type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, rows_per_salt: int = 2_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document.

    Texts are encoded once.  The driver sees only the histogram of lengths (``capacity`` rows) and
    plans on it.  Pieces are numbered within their length over salted groups of about
    ``rows_per_salt``, so a length that very many pieces share is numbered by many tasks; the number
    is the piece's seat in the plan.

    A null or empty text is a piece of one id, the end.  Repeated rows are packed each, rows without
    doc_id like others.  Which of several equally long pieces gets which seat follows a hash and then
    doc_id and piece; fully equal rows are interchangeable.  No rows give no rows.  Other columns are
    ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    pieces = ws.save(cut_pieces(docs, path, capacity, end_id), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    seats = spark.sparkContext.broadcast(_seats(plan_packing(histogram, capacity)))
    # a row a length at most
    salts = F.broadcast(spark.createDataFrame([(n, -(-k // rows_per_salt)) for n, k in histogram.items()], "length long, salts long"))
    salted = pieces.join(salts, "length").withColumn("salt", F.expr("pmod(xxhash64(doc_id, piece, ids_crc32), salts)"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    seated = salted.withColumn("number", number - 1).join(offsets, ["length", "salt"])
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    seated = seated.select(*kept, (F.col("before") + F.col("number")).alias("seat"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = seats.value
        for f in frames:
            seat = s["base"][f["length"].to_numpy()] + f["seat"].to_numpy()
            run = np.searchsorted(s["start"], seat, side="right") - 1
            yield f[kept].assign(sequence_id=s["sequence"][run] + seat - s["start"][run], offset=s["offset"][run])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return seated.mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
