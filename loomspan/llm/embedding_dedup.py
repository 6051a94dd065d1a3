"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .workspace import Workspace, small_side

_SEED = 20240229


def plan_tables(rows: int, cosine: float, recall: float, bucket: int) -> tuple[int, int]:
    """(bits, tables): buckets of about ``bucket`` vectors, and so many tables that a pair at the
    threshold meets in one of them with probability ``recall``; nearer pairs meet more surely."""
    bits = max(8, math.ceil(math.log2(max(2, rows / bucket))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One code of ``bits`` signs for each table: rows by tables."""
    planes = np.random.Generator(np.random.PCG64(_SEED)).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes >= 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.99, bucket: int = 16, block: int = 512, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, by cosine of the whole vectors in double precision.

    Equal vectors are one class.  Classes are dealt by each table's code; within a bucket, blocks of
    up to ``block`` classes are compared pair of blocks by pair of blocks, each in a task of its own,
    so a bucket of any size is spread out.  A pair counts in the first table where it meets.  Tasks
    give only each class's number of links and a spanning set of links, never all pairs.

    Null, empty and zero vectors, and those that hold a null or non-finite component, link with nothing
    and are components of their own; so are vectors of a length that no other has.  Rows that share a
    vec_id are counted as rows, and are one node.  No rows give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "near_vectors")
    good = "size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    base = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    base = base.withColumns({"h1": F.expr("xxhash64(v)"), "h2": F.expr("hash(v)"), "good": F.coalesce(F.expr(good), F.lit(False))})
    slim = ws.save(base.drop("v"), "slim")
    classes = slim.where("good and vec_id is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes = ws.save(classes, "classes")
    bits, tables = plan_tables(classes.count(), cosine, recall, bucket)
    kind = vectors.schema[key].dataType.simpleString()

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["v"].to_pylist()
            sizes = np.array([len(v) for v in lists], np.int64)
            for width in np.unique(sizes):
                at = np.flatnonzero(sizes == width)
                part = batch.take(pa.array(at))
                x = np.array([lists[i] for i in at], np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares within range
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                codes = _signatures(x, bits, tables).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part["node"], part["copies"], pa.array(np.full(len(x), width, np.int32)), *(pa.array([r.tobytes() for r in y], pa.binary()) for y in (x, codes)), pa.array(list(codes), pa.list_(pa.int32()))],
                    ["node", "copies", "width", "x", "codes", "list"],
                )

    held = base.where("good").join(small_side(classes.select(F.col("node").alias("vec_id"), "h1", "h2", "copies")), ["vec_id", "h1", "h2"]).dropDuplicates(["vec_id", "h1", "h2"])
    coded = held.select(F.col("vec_id").alias("node"), "copies", "v").mapInArrow(unit, f"node {kind}, copies long, width int, x binary, codes binary, list array<int>")
    coded = ws.save(coded, "coded")
    spots = coded.select("node", "width", F.posexplode("list").alias("t", "code"))
    fill = spots.groupBy("t", "width", "code").agg(F.count("*").alias("c")).where("c > 1").withColumn("parts", F.ceil(F.col("c") / block).cast("int"))
    spots = spots.join(fill, ["t", "width", "code"]).withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    # each block meets every other of its bucket, and itself, once
    spots = spots.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    spots = spots.select("t", "code", "node", "width", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    units = spots.join(coded.select("node", "width", "copies", "x", "codes"), ["node", "width"]).groupBy("t", "width", "code", "i", "j")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        t, width = group["t"][0].as_py(), group["width"][0].as_py()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        x = np.frombuffer(b"".join(group["x"].to_pylist()), np.float64).reshape(-1, width)
        codes = np.frombuffer(b"".join(group["codes"].to_pylist()), np.int32).reshape(len(x), -1)[:, :t]
        part, copies = group["part"].to_numpy(), group["copies"].to_numpy()
        degree, least = np.zeros(len(x), np.int64), np.arange(len(x))
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        links = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(left), 256):
            a = left[at : at + 256]
            r, c = np.nonzero(x[a] @ x[right].T >= cosine)
            r, c = a[r], right[c]
            new = (r < c) if i == j else np.ones(len(r), bool)
            if t:
                new &= ~(codes[r] == codes[c]).any(axis=1)  # counted in an earlier table
            links.append(np.stack([r[new], c[new]]))
        r, c = np.concatenate(links, axis=1)
        np.add.at(degree, r, copies[c])
        np.add.at(degree, c, copies[r])
        while len(r):  # the least member that links reach within this group
            before = least.copy()
            np.minimum.at(least, r, least[c])
            np.minimum.at(least, c, least[r])
            least = least[least]
            if (least == before).all():
                break
        some = np.flatnonzero(degree)
        return pa.table({"node": group["node"].take(pa.array(some)), "links": degree[some], "hub": group["node"].take(pa.array(least[some]))})

    found = ws.save(units.applyInArrow(compare, f"node {kind}, links long, hub {kind}"), "found")
    linked = connected_components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")), ws, "links")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(degree, "node", "left").join(linked, "node", "left").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    out = slim.where("good").join(named, ["h1", "h2"], "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = out.unionByName(slim.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
