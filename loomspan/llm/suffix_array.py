"""Distributed difference-cover suffix ranking on DataFrames.

A string is a table of blocks (block, names): ``names`` are 64-bit values of one stretch.  Each block's
length is a multiple of three and its last value occurs nowhere else, so no comparison of suffixes ever
leaves a block.  Triples at the places 1 and 2 mod 3 are sorted and named; if names repeat, the string
of names, two thirds as long, is ranked in the same way; then the remaining suffixes are merged in by
two sorts on (value, rank behind) and (value, value, rank behind).

Who only compares prefixes up to a length gives each value a size and says the length.  A triple that
long needs no further order, so its place decides between equal ones, and the recursion is as deep as
the shortest values demand and not as the longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, partitions_for, tidy

#: Strings of at most so many values are ranked by one task.
BASE = 100_000


def _table(batch) -> dict[str, np.ndarray]:
    return {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}


def _ordered(df: DataFrame, keys: list[str], rows: int):
    """Range-partitioned and sorted; places break ties, so that equal keys may span partitions."""
    order = [*keys, "block", "at"]
    parts = partitions_for(df.sparkSession, rows, 500_000)
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _name(triples: DataFrame, rows: int, enough: int, ws: Workspace, label: str) -> tuple[DataFrame, int]:
    """(block, at, name, size): ranks from 0 of the triples, and how many different ones there are."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, first = TaskContext.get().partitionId(), -1, None, None
        for batch in batches:
            t = _table(batch)
            keys = np.stack([t["t0"], t["t1"], t["t2"]], axis=1)
            if not len(keys):
                continue
            settled = t["size"] >= enough
            new = np.append(True, (keys[1:] != keys[:-1]).any(axis=1)) | settled
            if last is not None and (keys[0] == last).all() and not settled[0]:
                new[0] = False
            if first is None:
                first = [*keys[0].tolist(), int(settled[0])]
            names = seen + np.cumsum(new)
            seen, last = int(names[-1]), keys[-1].copy()
            n = len(names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(t["block"]), pa.array(t["at"]), pa.array(names), pa.array(t["size"]), pa.nulls(n, pa.list_(pa.int64()))], ["part", "block", "at", "name", "size", "edge"])
        if last is not None:
            edge = pa.array([[*first, *last.tolist()]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([seen + 1]), pa.nulls(1, pa.int32()), edge], ["part", "block", "at", "name", "size", "edge"])

    named = ws.save(_ordered(triples, ["t0", "t1", "t2"], rows).mapInArrow(tidy(local), "part int, block long, at long, name long, size int, edge array<long>"), label)
    before, total, last = [], 0, None
    for r in named.where("edge is not null").orderBy("part").select("part", "name", "edge").collect():  # one row a partition
        total -= last == r.edge[:3] and not r.edge[3]
        before.append((r.part, total))
        total, last = total + r.name, r.edge[4:]
    spark = triples.sparkSession
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    return named.where("edge is null").join(offsets, "part").select("block", "at", (F.col("name") + F.col("before")).alias("name"), "size"), total


def _merge_counts(rows: DataFrame, n: int, ws: Workspace, label: str) -> DataFrame:
    """(block, at, side, own, other): how many rows of the remaining suffixes and of the sampled ones come before on that side."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {1: [0, 0], 2: [0, 0]}
        for batch in batches:
            t = _table(batch)
            rest = (t["at"] % 3 == 0).astype(np.int64)
            own, other = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
            for side, held in seen.items():
                mine = t["side"] == side
                x = rest[mine]
                own[mine], other[mine] = held[0] + np.cumsum(x) - x, held[1] + np.cumsum(1 - x) - (1 - x)
                held[0], held[1] = held[0] + int(x.sum()), held[1] + int((1 - x).sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), part, np.int32)), pa.array(t["block"]), pa.array(t["at"]), pa.array(t["side"]), pa.array(own), pa.array(other)], names)
        yield pa.RecordBatch.from_arrays([pa.array([part] * 2, pa.int32()), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int64()), pa.array([1, 2], pa.int32()), pa.array([seen[1][0], seen[2][0]]), pa.array([seen[1][1], seen[2][1]])], names)

    fields = "part int, block long, at long, side int, own long, other long"
    names = [f.split()[0] for f in fields.split(", ")]
    counted = ws.save(_ordered(rows, ["side", "t0", "t1", "t2"], n).mapInArrow(tidy(local), fields), label)
    before, total = [], {1: (0, 0), 2: (0, 0)}
    for r in counted.where("block is null").orderBy("part").collect():  # two rows a partition
        a, b = total[r.side]
        before.append((r.part, r.side, a, b))
        total[r.side] = a + r.own, b + r.other
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, side int, a long, b long"))
    return counted.where("block is not null").join(offsets, ["part", "side"]).select("block", "at", "side", (F.col("own") + F.col("a")).alias("own"), (F.col("other") + F.col("b")).alias("other"))


def rank_suffixes(names: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of one string, by prefix doubling."""
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    k = 1
    while len(rank) and rank.max() + 1 < len(rank):
        behind = np.zeros(len(rank), np.int64)
        behind[:-k] = rank[k:] + 1
        rank = np.unique(rank * (len(rank) + 1) + behind, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return rank


def _whole(rows: pa.Table) -> pa.Table:
    names = [np.frombuffer(x, np.int64) for x in rows["names"].to_pylist()]
    ranks = np.split(rank_suffixes(np.concatenate(names)), np.cumsum([len(x) for x in names])[:-1])
    return pa.table({"block": rows["block"], "ranks": pa.array([r.astype(np.int64).tobytes() for r in ranks], pa.binary())})


def suffix_ranks(blocks: DataFrame, ws: Workspace, label: str = "dc", base: int = BASE, enough: int = 1 << 30) -> DataFrame:
    """(block, ranks): for each place of each block the rank, from 0, of its suffix among all.

    ``blocks`` has block (long), names (64-bit integers, any order) and sizes (32-bit).  Suffixes whose
    first values agree up to a total size of ``enough`` are neighbours in any order.  No blocks give no rows.
    """
    total = blocks.agg(F.sum(F.octet_length("names") / 8).cast("long")).first()[0] or 0
    if total <= base:
        return blocks.select("block", "names").groupBy(F.lit(0).alias("all")).applyInArrow(tidy(_whole), "block long, ranks binary")

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, sizes in zip(*(batch[c].to_pylist() for c in ("block", "names", "sizes")), strict=True):
                t = np.append(np.frombuffer(raw, np.int64), [0, 0])
                size = np.append(np.frombuffer(sizes, np.int32), [0, 0]).astype(np.int64)
                size = np.minimum(size[:-2] + size[1:-1] + size[2:], enough).astype(np.int32)
                at = np.arange(len(t) - 2)
                at = at[at % 3 != 0]
                yield pa.RecordBatch.from_arrays([pa.array(t[at]), pa.array(t[at + 1]), pa.array(t[at + 2]), pa.array(np.full(len(at), block)), pa.array(at), pa.array(size[at])], ["t0", "t1", "t2", "block", "at", "size"])

    sampled = total // 3 * 2
    named, distinct = _name(blocks.select("block", "names", "sizes").mapInArrow(tidy(triples), "t0 long, t1 long, t2 long, block long, at long, size int"), sampled, enough, ws, f"{label}_names")

    def shorter(rows: pa.Table) -> pa.Table:
        at, name, size = (rows[c].to_numpy() for c in ("at", "name", "size"))
        order = np.concatenate([np.flatnonzero(at % 3 == k)[np.argsort(at[at % 3 == k])] for k in (1, 2)])
        r, size = name[order], size[order]
        block = rows["block"][0].as_py()
        if distinct < sampled:
            pad = np.arange((-len(r)) % 3) + distinct + 3 * block  # larger than all names, and each used once
            r, size = np.append(r, pad), np.append(size, np.full(len(pad), enough, np.int32))
        return pa.table({"block": pa.array([block]), "names": pa.array([r.astype(np.int64).tobytes()], pa.binary()), "sizes": pa.array([size.astype(np.int32).tobytes()], pa.binary())})

    shorter_string = ws.save(named.groupBy("block").applyInArrow(tidy(shorter), "block long, names binary, sizes binary"), f"{label}_string")
    ws.drop(f"{label}_names")
    if distinct == sampled:
        samples = shorter_string.select("block", F.col("names").alias("ranks"))
    else:
        samples = suffix_ranks(shorter_string, ws, f"{label}c", base, enough)
    whole = ws.save(blocks.join(samples, "block").select("block", "names", "ranks"), f"{label}_whole")

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, ranks in zip(*(batch[c].to_pylist() for c in ("block", "names", "ranks")), strict=True):
                t = np.append(np.frombuffer(raw, np.int64), [0, 0])
                n = len(t) - 2
                s = np.frombuffer(ranks, np.int64)
                rank = np.full(n + 2, -1, np.int64)
                rank[1:n:3], rank[2:n:3] = s[: n // 3], s[n // 3 : n // 3 * 2]
                for side in (1, 2):
                    at = np.arange(n)
                    at = at[(at % 3 == 0) | (at % 3 == side)]
                    k2 = rank[at + 1] if side == 1 else t[at + 1]
                    k3 = np.zeros(len(at), np.int64) if side == 1 else rank[at + 2]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), side, np.int32)), pa.array(t[at]), pa.array(k2), pa.array(k3), pa.array(np.full(len(at), block)), pa.array(at)], ["side", "t0", "t1", "t2", "block", "at"])

    # both comparisons in one sort, side after side
    counts = _merge_counts(whole.mapInArrow(tidy(sides), "side int, t0 long, t1 long, t2 long, block long, at long"), 2 * sampled, ws, f"{label}_sides")

    def merged(rows: pa.Table, own: pa.Table) -> pa.Table:
        s = np.frombuffer(own["ranks"][0].as_py(), np.int64)
        n = len(own["names"][0].as_py()) // 8
        out = np.zeros(n, np.int64)
        out[1:n:3], out[2:n:3] = s[: n // 3], s[n // 3 : n // 3 * 2]
        at, a, b, side = (rows[c].to_numpy() for c in ("at", "own", "other", "side"))
        rest = at % 3 == 0
        out[at[rest & (side == 1)]] += (a + b)[rest & (side == 1)]
        out[at[rest & (side == 2)]] += b[rest & (side == 2)]
        out[at[~rest]] += a[~rest]
        return pa.table({"block": own["block"], "ranks": pa.array([out.tobytes()], pa.binary())})

    out = ws.save(counts.groupBy("block").cogroup(whole.groupBy("block")).applyInArrow(tidy(merged), "block long, ranks binary"), f"{label}_ranks")
    ws.drop(*(f"{label}_{x}" for x in ("string", "whole", "sides")), f"{label}c_ranks")
    return out
