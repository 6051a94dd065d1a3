"""Near duplicates by exact Jaccard similarity of word shingles: a grouped prefix join.

Two sets of similarity t share at least ``ceil(t n)`` shingles, so whatever the order of shingles, the
first ``n - ceil(t n) + l`` of either hold l of them.  In hash order, that leaves out sets of which too
few such shingles occur anywhere else.  For the sets that remain, how many of them have a shingle is
counted, and rare ones come first; now the first ``n - ceil(t n) + 1`` are a set's prefix.  Sets of equal
prefix and size are one group; groups that share a prefix shingle are candidates; members of the groups
are expanded and verified on their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .components import connected_components
from .workspace import Workspace, small_side, tidy

#: Shingles that a task holds at a time, and about as many as a bucket of shingles gets.
HELD = 500_000


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; fewer than n words make one shingle, none make none."""
    for docs in textkit.slices(column):
        begins, ends, first = docs.words()
        words = textkit.spans(docs.prefix(lower=True), begins, ends)
        for i in range(len(docs)):
            own = words[first[i] : first[i + 1]]
            yield docs.first + i, np.unique(textkit.grams(own, min(n, max(1, len(own)))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(bucket: np.ndarray, buckets: int, *columns: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """The buckets that have rows, and for each column the bytes of each bucket's values."""
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(edge)).tolist()
    sorted_ = [c[order] for c in columns]
    return some, [[c[edge[b] : edge[b + 1]].tobytes() for b in some] for c in sorted_]


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (tokens % np.uint64(buckets)).astype(np.int64)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys starts, and how long it is."""
    start = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, int)
    return start, np.diff(np.append(start, len(sorted_keys)))


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


_SCAN = "kind int, doc_id {}, n long, f1 long, f2 long, bucket int, tokens binary, owners binary, common binary, counts binary"


def _scan(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """Rows of documents (kind 0), their first shingles by hash (kind 1), and what is known of sharing (kind 2).

    A shingle that several sets of one part of the texts have is shared for each of them; only the
    fact is sent on, and not its holders.  So however many sets have a shingle, its bucket gets one
    entry from each part at most.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = _SCAN.format(kind)
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0

        def row(id_type: pa.DataType, k: int, code: int, **columns: pa.Array) -> pa.RecordBatch:
            kinds = dict.fromkeys(names, pa.binary()) | {"kind": pa.int32(), "doc_id": id_type, "n": pa.int64(), "f1": pa.int64(), "f2": pa.int64(), "bucket": pa.int32()}
            columns["kind"] = pa.array([code] * k, pa.int32())
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(k, kinds[c])) for c in names], names)

        def flushed(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not sets:
                return
            owners = np.array(list(sets), np.int64)
            key = np.concatenate(list(sets.values()))
            who = np.repeat(np.arange(len(owners)), [len(s) for s in sets.values()])
            sets.clear()
            held = 0
            order = np.argsort(key, kind="stable")
            key, who = key[order], who[order]
            start, count = _runs(key)
            alone = np.repeat(count == 1, count)
            shared = np.bincount(who[~alone], minlength=len(owners)).astype(np.uint32)
            token, single = key[alone], owners[who[alone]]
            common = key[start[count > 1]]
            some, (tokens, holders) = _cut(_bucket(token, buckets), buckets, token, single)
            yield row(id_type, len(some), 1, bucket=pa.array(some, pa.int32()), tokens=pa.array(tokens, pa.binary()), owners=pa.array(holders, pa.binary()))
            some, (both,) = _cut(_bucket(common, buckets), buckets, common)
            yield row(id_type, len(some), 1, bucket=pa.array(some, pa.int32()), common=pa.array(both, pa.binary()))
            some, (who, n_shared) = _cut(owners % buckets, buckets, owners, shared)
            yield row(id_type, len(some), 2, bucket=pa.array(some, pa.int32()), owners=pa.array(who, pa.binary()), counts=pa.array(n_shared, pa.binary()))

        id_type = pa.null()
        for batch in batches:
            id_type, rows = batch["doc_id"].type, []
            for _, s in shingle_sets(batch["text"], n):
                size = len(s)
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                f1, f2 = _signed(whole >> 64), _signed(whole & (1 << 64) - 1)
                rows.append((size, f1, f2))
                if size and f1 not in sets:
                    sets[f1] = s[: size - -(-percent * size // 100) + max(1, size // 10)]
                    held += len(sets[f1])
                if held > HELD:
                    yield from flushed(id_type)
            if rows:
                cols = {c: pa.array(x, pa.int64()) for c, x in zip(("n", "f1", "f2"), zip(*rows, strict=True), strict=True)}
                yield row(id_type, len(rows), 0, doc_id=batch["doc_id"], **cols)
        yield from flushed(id_type)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), fields)


def _shared_by_owner(blocks: int):
    def count(parts: pa.Table) -> pa.Table:
        """How many of each owner's shingles of this bucket others have too, by block of owners."""
        single = parts.filter(parts["tokens"].is_valid())
        token, owner = _joined(single["tokens"], np.uint64), _joined(single["owners"], np.int64)
        common = np.unique(_joined(parts.filter(parts["common"].is_valid())["common"], np.uint64))
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        start, n = _runs(token)
        several = np.zeros(0, bool)
        if len(start):
            several = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
            several |= np.isin(token[start], common)
        who, times = np.unique(owner[np.repeat(several, n)], return_counts=True)
        some, (owners, counts) = _cut(who % blocks, blocks, who, times.astype(np.uint32))
        return pa.table({"block": pa.array(some, pa.int32()), "owners": pa.array(owners, pa.binary()), "counts": pa.array(counts, pa.binary()), "parts": pa.array([0] * len(some), pa.int32())})

    return count


def _total(rows: pa.Table) -> pa.Table:
    """(f1, shared): an owner that several parts have, as a copy, is counted in each, so the sum is divided by them."""
    owner, n = _joined(rows["owners"], np.int64), _joined(rows["counts"], np.uint32)
    each = np.repeat(rows["parts"].to_numpy(), [len(x) // 8 for x in rows["owners"].to_pylist()])
    who, at = np.unique(owner, return_inverse=True)
    total, parts = np.bincount(at, n, len(who)), np.bincount(at, each, len(who))
    return pa.table({"f1": who, "shared": (total / np.maximum(parts, 1)).astype(np.int64)})


_PART = "part long, f1 long, n long, places binary, bucket int, tokens binary, counts binary"


def _ask(sets: DataFrame, buckets: int) -> DataFrame:
    """Parts of about HELD shingles: each set as places among the part's different shingles, and those by bucket."""
    names = [f.split()[0] for f in _PART.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, flush, held, rows = TaskContext.get().partitionId(), 0, 0, []

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal flush, held
            if not rows:
                return
            part = (task << 32) + flush
            flush, held = flush + 1, 0
            tokens, places, counts = np.unique(np.concatenate([s for _, s in rows]), return_inverse=True, return_counts=True)
            order = np.argsort(_bucket(tokens, buckets), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            places, tokens, counts = rank[places], tokens[order], counts[order].astype(np.uint32)
            k, edge = len(rows), np.append(0, np.cumsum([len(s) for _, s in rows]))
            cols = [pa.array([part] * k), pa.array([f for f, _ in rows], pa.int64()), pa.array(np.diff(edge)), pa.array([places[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names)
            some, (t, c) = _cut(_bucket(tokens, buckets), buckets, tokens, counts)
            k = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([part] * k), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(some, pa.int32()), pa.array(t, pa.binary()), pa.array(c, pa.binary())], names)
            rows.clear()

        for batch in batches:
            for f1, raw in zip(batch["f1"].to_pylist(), batch["shingles"].to_pylist(), strict=True):
                rows.append((f1, np.frombuffer(raw, np.uint64)))
                held += len(rows[-1][1])
                if held > HELD:
                    yield from flushed()
        yield from flushed()

    return sets.select("f1", "shingles").mapInArrow(tidy(run), _PART)


def _answer(asked: pa.Table) -> pa.Table:
    """To each part that asks, how many sets have each of its shingles of this bucket."""
    tokens, counts = _joined(asked["tokens"], np.uint64), _joined(asked["counts"], np.uint32)
    _, at = np.unique(tokens, return_inverse=True)
    total = np.minimum(np.bincount(at, counts), (1 << 32) - 1).astype(np.uint32)[at] if len(at) else counts
    edge = np.append(0, np.cumsum([len(x) // 8 for x in asked["tokens"].to_pylist()]))
    return pa.table({"part": asked["part"], "bucket": asked["bucket"], "holders": pa.array([total[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})


def _prefixes(percent: int):
    def order(own: pa.Table, answers: pa.Table) -> pa.Table:
        """(f1, gid, n, alone, tokens): each set's prefix without the shingles that it alone has, if anything is left of it."""
        asked = own.filter(own["tokens"].is_valid()).sort_by("bucket")
        tokens, holders = _joined(asked["tokens"], np.uint64), _joined(answers.sort_by("bucket")["holders"], np.uint32)
        rows = own.filter(own["places"].is_valid())
        out = []
        for f1, raw in zip(rows["f1"].to_pylist(), rows["places"].to_pylist(), strict=True):
            places = np.frombuffer(raw, np.uint32)
            token, many = tokens[places], holders[places]
            some = many > 1
            n, alone = len(places), len(places) - int(some.sum())
            keep = n - -(-percent * n // 100) + 1 - alone
            if keep > 0 and alone < n:
                token, many = token[some], many[some]
                prefix = token[np.lexsort((token, many))[:keep]].tobytes()
                out.append((f1, f1 if alone else _signed(xxhash.xxh3_64_intdigest(prefix, seed=n)), n, alone, prefix))
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("f1", "gid", "n", "alone"), cols[:4], strict=True)} | {"tokens": pa.array(cols[4], pa.binary())})

    return order


_DEALT = "bucket int, tokens binary, gids binary, sizes binary, places binary"


def _deal_prefixes(prefixes: DataFrame, buckets: int) -> DataFrame:
    """Each prefix shingle of each group with the group's size and the shingle's place in its order."""
    names = [f.split()[0] for f in _DEALT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch["tokens"].to_pylist()
            count = np.array([len(x) // 8 for x in raw], np.int64)
            tokens = np.frombuffer(b"".join(raw), np.uint64)
            gid, n, alone = (np.repeat(batch[c].to_numpy(), count) for c in ("gid", "n", "alone"))
            place = alone + np.arange(len(tokens)) - np.repeat(np.cumsum(count) - count, count)
            some, cols = _cut(_bucket(tokens, buckets), buckets, tokens, gid, n.astype(np.uint32), place.astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names)

    return prefixes.select("gid", "n", "alone", "tokens").mapInArrow(tidy(run), _DEALT)


def _shared_lists(percent: int):
    def lists(parts: pa.Table) -> pa.Table:
        """(list, gid, hub) of each different set of groups that share a prefix shingle and may hold linked sets.

        Groups of one shingle are sorted by size and cut where neighbours differ too much.  Of two that are
        left, the places of the shingle say how many others they can still share; too few, and they go.
        """
        key, gid = _joined(parts["tokens"], np.uint64), _joined(parts["gids"], np.int64)
        n, place = (_joined(parts[c], np.uint32).astype(np.int64) for c in ("sizes", "places"))
        order = np.lexsort((gid, n, key))
        key, gid, n, place = key[order], gid[order], n[order], place[order]
        new = np.append(True, (key[1:] != key[:-1]) | (100 * n[:-1] < percent * n[1:])) if len(key) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(key)))
        start, count = start[count > 1], count[count > 1]
        rest = n - place  # what a set has from this shingle on
        second = start + (count == 2)
        need = -(-percent * (n[start] + n[second]) // (100 + percent))
        some = (count > 2) | (np.minimum(rest[start], rest[second]) >= need)
        start, count = start[some], count[some]
        if not len(start):
            return pa.table({c: pa.array([], pa.int64()) for c in ("list", "gid", "hub")})
        edge = np.cumsum(count) - count
        member = gid[np.repeat(start - edge, count) + np.arange(count.sum())]
        name = textkit.mix(np.add.reduceat(textkit.mix(member.astype(np.uint64)), edge) + count.astype(np.uint64))
        _, first = np.unique(name, return_index=True)
        keep = np.zeros(len(count), bool)
        keep[first] = True
        rows = np.repeat(keep, count)
        return pa.table({"list": np.repeat(name.astype(np.int64), count)[rows], "gid": member[rows], "hub": np.repeat(member[edge], count)[rows]})

    return lists


def link_within(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the least index that a chain of links from it reaches; all pairs are judged exactly."""
    size = np.array([len(s) for s in sets])
    group = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(group, kind="stable")
    holder, edge = owner[order], np.append(0, np.cumsum(np.bincount(group)))
    parent = np.arange(len(sets))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    begin = np.append(0, np.cumsum(size))
    for i in range(len(sets)):
        own = group[begin[i] : begin[i + 1]]
        lo, k = edge[own], edge[own + 1] - edge[own]
        lo, k = lo[k > 1], k[k > 1]
        if not len(k):
            continue
        at = np.repeat(lo - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(k.sum())
        both = np.bincount(holder[at], minlength=len(sets))
        both[: i + 1] = 0
        for j in np.flatnonzero(100 * both >= percent * (size + size[i] - both)):
            a, b = find(i), find(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(sets))])


def ngram_jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, unit: int = 1024, weight: int = 1_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; links are pairs with 100 * both >= percent * either.

    Copies are judged once, as one class.  Groups that share prefix shingles, directly or through others,
    form clusters; pairs that sizes or the shingle's places rule out do not count.  A cluster of up to
    ``unit`` classes and ``weight`` shingles is verified by one task.  A larger one is cut by set size into
    blocks, and each pair of blocks, unless too different in size, is one task's work.  Of clusters of
    more than 64 units, each list of groups that share a shingle is treated so by itself.  Only sets of
    clustered documents are moved, and no pair is written as a row.

    A null or empty text, or one of white space, has no shingles and is linked with nothing.  With fewer
    than ``n`` words the whole sequence is the only shingle.  Rows that share a doc_id count as one
    document, whatever their texts, and repeated rows as one row.  Rows without doc_id get no component
    unless a copy has one.  No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "ngram_join")
    docs = docs.select("doc_id", "text")
    # of about six bytes a word, some 35 of 100 shingles are dealt
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, size // 6 * 35 // 100 // HELD)
    scan = ws.save(_scan(docs, n, percent, buckets), "scan")
    rows = ws.save(scan.where("kind = 0").select("doc_id", "n", "f1", "f2"), "rows")
    classes = ws.save(rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node")).where("node is not null"), "classes")
    dealt = scan.where("kind = 1").select("bucket", "tokens", "owners", "common").repartition(buckets, "bucket").groupBy("bucket")
    counts = dealt.applyInArrow(tidy(_shared_by_owner(buckets)), "block int, owners binary, counts binary, parts int")
    counts = counts.unionByName(scan.where("kind = 2").select(F.col("bucket").alias("block"), "owners", "counts", F.lit(1).alias("parts")))
    shared = counts.groupBy("block").applyInArrow(tidy(_total), "f1 long, shared long")
    # a set of n shingles may be linked with one of percent * n, which is sure to share so many of its first
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 10))
    left = ws.save(classes.join(shared, "f1").where(F.col("shared") >= least).select("node", "f1", "f2", "n"), "left")
    ws.drop("scan")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, f1s, held = batch["doc_id"], [], []
            for _, s in shingle_sets(batch["text"], n):
                held.append(s.tobytes())
                f1s.append(_signed(xxhash.xxh3_128_intdigest(held[-1]) >> 64))
            yield pa.RecordBatch.from_arrays([keys, pa.array(f1s, pa.int64()), pa.array(held, pa.binary())], ["node", "f1", "shingles"])

    wanted = docs.join(small_side(left.select(F.col("node").alias("doc_id")).distinct(), 64 << 20), "doc_id", "left_semi")
    found = ws.save(wanted.mapInArrow(tidy(sets), f"node {kind}, f1 long, shingles binary"), "sets")
    tokens = found.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    buckets = max(8, tokens // 8 // HELD)
    parts = ws.save(_ask(found, buckets), "parts")
    answers = parts.where("bucket is not null").select("part", "bucket", "tokens", "counts").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(tidy(_answer), "part long, bucket int, holders binary")
    own = parts.select("part", "f1", "places", "bucket", "tokens").groupBy("part")
    prefixes = own.cogroup(answers.groupBy("part")).applyInArrow(tidy(_prefixes(percent)), "f1 long, gid long, n long, alone long, tokens binary")
    prefixes = ws.save(prefixes.dropDuplicates(["f1"]), "prefixes")
    ws.drop("parts")
    lists = _deal_prefixes(prefixes.dropDuplicates(["gid"]), buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(tidy(_shared_lists(percent)), "list long, gid long, hub long")
    lists = ws.save(lists.dropDuplicates(["list", "gid"]), "lists")
    clusters = connected_components(lists.select(F.col("gid").alias("a"), F.col("hub").alias("b")), ws, "clusters")
    placed = left.join(prefixes.select("f1", "gid"), "f1").join(clusters.withColumnRenamed("node", "gid"), "gid", "left").select("node", "f1", "n", "gid", F.coalesce("component", "gid").alias("cluster"))
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    placed = ws.save(placed.join(sizes, "cluster"), "placed")
    whole = (F.col("members") <= unit) & (F.col("shingles") <= weight)
    small = placed.where(whole).select("node", "f1", F.struct(F.lit(0).alias("k"), F.col("cluster").alias("u"), F.lit(0).alias("i"), F.lit(0).alias("j")).alias("unit"))
    big = _large_units(placed.where(~whole).drop("shingles"), lists, unit, weight, percent)
    units = small.unionByName(big) if big is not None else small

    def verify(group: pa.Table) -> pa.Table:
        held = {}
        for node, f1, raw in zip(*(group[c].to_pylist() for c in ("node", "f1", "shingles")), strict=True):
            held[node, f1] = np.frombuffer(raw, np.uint64)
        nodes = sorted(held)
        least = link_within([held[x] for x in nodes], percent)
        linked = np.flatnonzero(least != np.arange(len(least)))
        t = group["node"].type
        return pa.table({"a": pa.array([nodes[i][0] for i in linked], t), "b": pa.array([nodes[i][0] for i in least[linked]], t)})

    links = units.join(found, ["node", "f1"]).groupBy("unit").applyInArrow(tidy(verify), f"a {kind}, b {kind}")
    linked = connected_components(links, ws, "links")
    named = classes.join(linked, "node", "left").select("f1", "f2", "n", F.coalesce("component", "node").alias("component_id"))
    out = rows.join(named, ["f1", "f2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _large_units(placed: DataFrame, lists: DataFrame, unit: int, weight: int, percent: int) -> DataFrame | None:
    """Units of clusters that are too large for one task, or None if there are no such clusters."""
    if not placed.limit(1).count():
        return None
    cols = ["gid", "node", "f1", "n"]
    whole = placed.where(F.col("members") <= 64 * unit).select(F.col("cluster").alias("list"), *cols)
    largest = placed.where(F.col("members") > 64 * unit)
    members = lists.select("list", "gid").join(largest.select(*cols), "gid").select("list", *cols)
    twins = largest.select(F.col("gid").alias("list"), *cols)  # classes of one group
    members = whole.unionByName(members).unionByName(twins)
    per = members.groupBy("list").agg(F.count("*").alias("k"), F.sum("n").alias("w")).where("k > 1")
    members = members.join(per, "list")
    # blocks of neighbouring sizes: every power of 1.05 is dealt into as many parts as its sets need
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.05))).cast("int")
    banded = members.withColumn("band", F.when((F.col("k") <= unit) & (F.col("w") <= weight), F.lit(0)).otherwise(band))
    parts = F.greatest(F.ceil(F.col("c") / (unit / 2)), F.ceil(F.col("s") / (weight / 2))).cast("int")
    one = (F.col("c") <= unit) & (F.col("s") <= weight)
    fill = banded.groupBy("list", "band").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("list", "band", F.when(one, F.lit(1)).otherwise(parts).alias("parts"))
    banded = banded.join(fill, ["list", "band"]).withColumn("block", F.col("band") * 1_000_000 + F.expr("cast(pmod(xxhash64(node, f1), parts) as int)"))
    blocks = banded.select("list", "block", "band").distinct()
    reach = int(np.ceil(np.log(100 / percent) / np.log(1.05))) + 1
    pairs = blocks.select("list", F.col("block").alias("i"), F.col("band").alias("bi")).join(blocks.select("list", F.col("block").alias("j"), F.col("band").alias("bj")), "list")
    pairs = pairs.where((F.col("i") <= F.col("j")) & (F.col("bj") - F.col("bi") <= reach)).select("list", "i", "j")
    sides = pairs.select("list", "i", "j", F.col("i").alias("block")).unionByName(pairs.where("i < j").select("list", "i", "j", F.col("j").alias("block")))
    return banded.join(sides, ["list", "block"]).select("node", "f1", F.struct(F.lit(1).alias("k"), F.col("list").alias("u"), "i", "j").alias("unit"))
