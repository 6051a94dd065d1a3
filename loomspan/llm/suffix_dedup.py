"""Removal of byte strings that occur again anywhere: a suffix array over phrases, then exact byte checks.

Texts are cut into phrases at places that depend on nearby bytes only, so equal stretches are cut alike.
A place is a cut if the hash of the ``GRAM`` bytes from it is the least of some ``window_of(span)`` neighbours.
Let a string of ``span`` bytes occur twice.  The cuts from the first to the last that are chosen within
it are the same in both; the first lies less than that window from its start, and all phrases of the
following ``RUN`` bytes or more are shared.  So phrases that occur once can go, and what is left is a
much shorter string whose suffixes the difference-cover algorithm sorts, ``span`` bytes deep.  The longest
common prefix of each two neighbours in that order is measured phrase by phrase; places where it has ``RUN``
bytes or more are the candidates, whose bytes around the cut are then compared.  No place shares more with
any other than with one of its neighbours, so the greatest of these lengths also says how long a stretch a
text has in common with one other place, below ``span`` bytes, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .suffix_array import BASE, suffix_ranks
from .workspace import Workspace, partitions_for, small_side, tidy

SPAN, GRAM, RUN = 400, 16, 66
_TOP = np.uint64((1 << 64) - 1)


def window_of(span: int) -> int:
    """The widest window by which any string of ``span`` bytes has whole phrases of RUN bytes behind its first cut.

    From that cut the string has ``span - window + 1`` bytes at least.  Phrases are at most a window long.
    """
    window = (span + 2 - GRAM - RUN) // 2
    if not GRAM <= window <= 255:  # lengths of phrases are kept in a byte
        raise ValueError(f"span {span}: from 112 to 591 bytes are possible")
    return window


def _slide(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least or greatest of each w values in a row."""
    edge, pick = (_TOP, np.minimum) if least else (np.uint64(0), np.maximum)
    n = len(x) - w + 1
    rows = np.append(x, np.full(-len(x) % w + w, edge, np.uint64)).reshape(-1, w)
    ahead = pick.accumulate(rows, axis=1).ravel()
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[w - 1 : w - 1 + n])


def cuts(docs: textkit.Docs, sums: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Places of all cuts in the buffer, in order."""
    n, window = len(docs.data) - GRAM + 1, window_of(span)
    if n < window:
        return np.zeros(0, np.int64)
    gram = textkit.spans(sums, np.arange(n), np.arange(GRAM, n + GRAM))
    for e in docs.ends:  # grams that would cross into the next document
        gram[max(0, e - GRAM + 1) : e] = _TOP
    least = _slide(gram, window, True)
    for e in docs.ends:  # windows that would, too
        least[max(0, e - window + 1) : e] = 0
    most = _slide(np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)]), window, False)
    return np.flatnonzero((most[:n] == gram) & (gram != _TOP))


def _phrases(docs: DataFrame, buckets: int, span: int) -> DataFrame:
    """Phrases of ``text`` dealt by their hash: (bucket, hashes, uids, sizes, offs, lens) in packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch["uid"].to_numpy()
            for d in textkit.slices(batch["text"]):
                sums = d.prefix()
                at = cuts(d, sums, span)
                owner = np.searchsorted(d.starts, at, side="right") - 1
                same = np.flatnonzero(owner[1:] == owner[:-1])
                if not len(same):
                    continue
                a, b, owner = at[same], at[same + 1], owner[same]
                h = textkit.spans(sums, a, b)
                deal = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(deal, kind="stable")
                cut = np.searchsorted(deal[order], np.arange(buckets + 1))
                rows = []
                for k in range(buckets):
                    x = order[cut[k] : cut[k + 1]]
                    if len(x):
                        who, size = np.unique(owner[x], return_counts=True)
                        rows.append((k, h[x].tobytes(), uids[d.first + who].tobytes(), size.astype(np.uint32).tobytes(), (a - d.starts[owner])[x].astype(np.uint32).tobytes(), (b - a)[x].astype(np.uint8).tobytes()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "hashes", "uids", "sizes", "offs", "lens"])

    return docs.select("uid", "text").mapInArrow(tidy(run), "bucket int, hashes binary, uids binary, sizes binary, offs binary, lens binary")


def _repeated(rows: pa.Table) -> pa.Table:
    """Phrases of a bucket that occur at two or more places."""
    join = lambda c, kind: np.frombuffer(b"".join(rows[c].to_pylist()), kind)
    h, off, size = join("hashes", np.uint64), join("offs", np.uint32), join("lens", np.uint8)
    uid = np.repeat(join("uids", np.int64), join("sizes", np.uint32))
    order = np.lexsort((off, uid, h))
    h, off, size, uid = h[order], off[order], size[order], uid[order]
    new = np.append(True, (h[1:] != h[:-1]) | (uid[1:] != uid[:-1]) | (off[1:] != off[:-1])) if len(h) else np.zeros(0, bool)
    h, off, size, uid = h[new], off[new], size[new], uid[new]
    twin = np.zeros(len(h), bool)
    twin[1:] = h[1:] == h[:-1]
    twin[:-1] |= twin[1:]
    return pa.table({"uid": uid[twin], "off": off[twin].astype(np.int32), "len": size[twin].astype(np.int32), "name": h[twin].astype(np.int64)})


def _block(rows: pa.Table, span: int) -> pa.Table:
    """One stretch of the string: runs of phrases, each followed by a separator that occurs nowhere else."""
    uid, off, size, name = (rows[c].to_numpy() for c in ("uid", "off", "len", "name"))
    order = np.lexsort((off, uid))
    uid, off, size, name = uid[order], off[order].astype(np.int64), size[order].astype(np.int64), name[order]
    block = rows["block"][0].as_py()
    last = np.append((uid[1:] != uid[:-1]) | (off[1:] != off[:-1] + size[:-1]), True)
    at = np.arange(len(uid)) + np.append(0, np.cumsum(last)[:-1])
    n = len(uid) + int(last.sum())
    n += -n % 3
    seed = textkit.mix(np.array([block], np.int64).astype(np.uint64) + np.uint64(77))
    names = textkit.mix(seed + np.arange(n, dtype=np.uint64)).astype(np.int64)
    names[at] = name
    sizes = np.full(n, span, np.int32)
    sizes[at] = size
    whose, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)  # separators have no place
    whose[at], where[at] = uid, off
    cols = {"names": names, "sizes": sizes, "uids": whose, "offs": where}
    return pa.table({"block": pa.array([block])} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in cols.items()})


#: Equal phrases in a row at the head of a suffix are one entry.
_ENTRY = np.dtype([("name", "<i8"), ("size", "<u2"), ("count", "<u2")])


def _heads(names: np.ndarray, sizes: np.ndarray, places: np.ndarray, span: int = SPAN) -> pa.Array:
    """For each place the phrases from it up to the first end at ``span`` bytes or more, as entries."""
    through = np.cumsum(sizes.astype(np.int64))
    ends = np.searchsorted(through, through[places] - sizes[places] + span)
    starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
    stops = np.append(starts[1:], len(names)) - 1
    run = np.searchsorted(starts, np.arange(len(names)), side="right") - 1
    n = run[ends] - run[places] + 1
    first = np.append(0, np.cumsum(n))
    which = np.repeat(run[places] - first[:-1], n) + np.arange(first[-1])
    out = np.zeros(first[-1], _ENTRY)
    out["name"], out["size"] = names[starts[which]], sizes[starts[which]]
    out["count"] = np.minimum(stops[which], np.repeat(ends, n)) - np.maximum(starts[which], np.repeat(places, n)) + 1
    offsets = (first * _ENTRY.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def shared_prefixes(heads: pa.Array) -> np.ndarray:
    """Bytes of the whole phrases that each head shares with the next one at their beginning."""
    n = max(len(heads) - 1, 0)
    total = np.zeros(n, np.int64)
    if not n:
        return total
    _, offsets, data = heads.buffers()
    first = np.frombuffer(offsets, np.int32)[heads.offset : heads.offset + n + 2].astype(np.int64) // _ENTRY.itemsize
    entries = np.frombuffer(data, _ENTRY, count=int(first[-1]))
    alive, step = np.arange(n), 0
    while len(alive):
        alive = alive[(first[alive] + step < first[alive + 1]) & (first[alive + 1] + step < first[alive + 2])]
        x, y = entries[first[alive] + step], entries[first[alive + 1] + step]
        same = x["name"] == y["name"]
        alive, x, y = alive[same], x[same], y[same]
        total[alive] += np.minimum(x["count"], y["count"]).astype(np.int64) * x["size"]
        alive, step = alive[x["count"] == y["count"]], step + 1
    return total


def _neighbours(blocks: DataFrame, ranks: DataFrame, rows: int, span: int) -> DataFrame:
    """(uid, off, lcp, rank, edge): places whose longest common prefix with a neighbour in suffix order has RUN bytes or more.

    The first and the last place of each range of ranks come with their head in ``edge``, whatever they share.
    """
    fields = "uid long, off long, lcp long, rank long, edge binary"
    names = [f.split()[0] for f in fields.split(", ")]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("ranks", "names", "sizes", "uids", "offs")), strict=True):
                kinds = (np.int64, np.int64, np.int32, np.int64, np.int64)
                rank, name, size, uid, off = (np.frombuffer(x, k) for x, k in zip(row, kinds, strict=True))
                bounds = np.flatnonzero(off < 0)
                at = np.flatnonzero(off >= 0)
                through = np.cumsum(size.astype(np.int64))
                at = at[through[bounds[np.searchsorted(bounds, at)] - 1] - through[at] + size[at] >= RUN]
                for x in np.array_split(at, len(at) // 50_000 + 1):
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[x]) for c in (rank, uid, off)), _heads(name, size, x, span)], ["rank", "uid", "off", "head"])

    def adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.RecordBatch, lcp: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            some = (lcp >= RUN) | edge
            x = rows.filter(pa.array(some))
            head = [h if e else None for h, e in zip(x["head"].to_pylist(), edge[some].tolist(), strict=True)] if edge.any() else [None] * x.num_rows
            return pa.RecordBatch.from_arrays([x["uid"], x["off"], pa.array(lcp[some]), x["rank"], pa.array(head, pa.binary())], names)

        held, before, first = None, 0, True  # the last row so far, and what it shares with the one before
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.RecordBatch.from_arrays([pa.concat_arrays([held[c], batch[c]]) for c in batch.schema.names], batch.schema.names)
            common = shared_prefixes(rows["head"])
            lcp = np.maximum(np.append(before, common), np.append(common, 0))
            edge = np.zeros(len(lcp), bool)
            edge[0] = first
            if len(lcp) > 1:
                yield out(rows[:-1], lcp[:-1], edge[:-1])
                first = False
            held, before = rows[-1:], int(lcp[-1])
        if held is not None:
            yield out(held, np.array([before]), np.array([True]))

    spots = blocks.join(ranks, "block").select("ranks", "names", "sizes", "uids", "offs").mapInArrow(tidy(spread), "rank long, uid long, off long, head binary")
    parts = partitions_for(blocks.sparkSession, rows, 500_000)
    return spots.repartitionByRange(parts, "rank").sortWithinPartitions("rank").mapInArrow(tidy(adjacent), fields)


def _candidates(places: DataFrame) -> DataFrame:
    """(uid, off, lcp) of at least RUN bytes; what places share across ranges is found from two rows a range, on the driver."""
    edges = places.where("edge is not null").select("uid", "off", "edge").orderBy("rank").collect()
    common = shared_prefixes(pa.array([r.edge for r in edges], pa.binary()))
    beyond = np.maximum(np.append(0, common), np.append(common, 0)).tolist()
    met = places.sparkSession.createDataFrame([(r.uid, r.off, x) for r, x in zip(edges, beyond)], "uid long, off long, beyond long")
    both = places.join(F.broadcast(met), ["uid", "off"], "left")
    return both.select("uid", "off", F.greatest("lcp", F.coalesce("beyond", F.lit(0))).alias("lcp")).where(F.col("lcp") >= RUN)


def _contexts(docs: DataFrame, raw: bool, span: int) -> DataFrame:
    """Of each place: core and ctx, hashes of the bytes behind the cut and around it; or the bytes around it."""
    left = window_of(span) - 1
    fields = "core long, ctx long, l int, raw binary" if raw else "core long, ctx long, h1 long, h2 long, off long, l int, r int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs = batch["offs"].to_pylist()
            for d in textkit.slices(batch["text"]):
                each = [np.array(offs[d.first + i], np.int64) for i in range(len(d))]
                owner = np.repeat(np.arange(len(d)), [len(x) for x in each])
                p = np.concatenate(each) + d.starts[owner]
                lo, hi = np.maximum(d.starts[owner], p - left), np.minimum(d.ends[owner], p + span)
                ok = (p >= d.starts[owner]) & (p + span - left <= hi)
                p, lo, hi, owner = p[ok], lo[ok], hi[ok], owner[ok]
                sums = d.prefix()
                core = textkit.spans(sums, p, p + span - left).astype(np.int64)
                ctx = textkit.mix(textkit.spans(sums, lo, hi) + (p - lo).astype(np.uint64) * np.uint64(1000) + (hi - p).astype(np.uint64)).astype(np.int64)
                if raw:
                    data = d.data.tobytes()
                    texts = [data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                    cols = [pa.array(core), pa.array(ctx), pa.array((p - lo).astype(np.int32)), pa.array(texts, pa.binary())]
                else:
                    h1, h2 = (batch[c].to_numpy()[d.first + owner] for c in ("h1", "h2"))
                    cols = [*map(pa.array, (core, ctx, h1, h2, p - d.starts[owner], (p - lo).astype(np.int32), (hi - p).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in fields.split(", ")])

    return docs.select("h1", "h2", "text", "offs").mapInArrow(tidy(run), fields)


def _window_keys(core: np.ndarray, left: np.ndarray, raws: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context and each number a of bytes before the cut: a hash of that ``span``-byte string, and whether it is there."""
    m, window = len(raws), window_of(span)
    size = np.array([len(x) for x in raws])
    data = np.frombuffer(b"".join(raws), np.uint8)
    begin = np.append(0, np.cumsum(size)[:-1]) + left
    right = size - left
    a = np.arange(window)
    at = begin[:, None] - a[None, :]
    there = (a[None, :] <= left[:, None]) & (span - a[None, :] <= right[:, None])
    power = textkit._power("up", 2 * window)
    before = textkit._BYTE[data[np.clip(at, 0, len(data) - 1)]] * power[None, :window]
    before[:, 0] = 0
    before = np.cumsum(before, axis=1)  # bytes p-1 to p-a
    back = begin[:, None] + span - window + 1 + np.arange(window)[None, :]
    behind = textkit._BYTE[data[np.clip(back, 0, len(data) - 1)]] * power[None, window:]
    behind = np.cumsum(np.concatenate([np.zeros((m, 1), np.uint64), behind[:, : window - 1]], axis=1), axis=1)  # the j bytes behind the core
    keys = textkit.mix(before + behind[:, ::-1] + core.astype(np.uint64)[:, None] + textkit.mix(a.astype(np.uint64))[None, :])
    return keys, there


def _extents(rows: pa.Table, span: int) -> pa.Table:
    """(core, ctx, most, least): the range of a at which a context's string is another context's, too."""
    core, ctx, window = rows["core"].to_numpy(), rows["ctx"].to_numpy(), window_of(span)
    keys, there = _window_keys(core, rows["l"].to_numpy().astype(np.int64), rows["raw"].to_pylist(), span)
    most, least = np.full(len(core), -1), np.full(len(core), window)
    for a in range(window):
        some = np.flatnonzero(there[:, a])
        k = keys[some, a]
        order = np.argsort(k)
        k = k[order]
        twin = np.zeros(len(k), bool)
        twin[1:] = k[1:] == k[:-1]
        twin[:-1] |= twin[1:]
        found = some[order[twin]]
        most[found] = a
        least[found] = np.minimum(least[found], a)
    ok = most >= 0
    return pa.table({"core": core[ok], "ctx": ctx[ok], "most": most[ok].astype(np.int32), "least": least[ok].astype(np.int32)})


def _extents_of_large(rows: DataFrame, span: int) -> DataFrame:
    """The same for cores with so many contexts that their strings' hashes are met in Spark."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                core, ctx = batch["core"].to_numpy(), batch["ctx"].to_numpy()
                keys, there = _window_keys(core, batch["l"].to_numpy().astype(np.int64), batch["raw"].to_pylist(), span)
                i, a = np.nonzero(there)
                yield pa.RecordBatch.from_arrays([pa.array(core[i]), pa.array(ctx[i]), pa.array(a.astype(np.int32)), pa.array(keys[i, a].astype(np.int64))], ["core", "ctx", "a", "key"])

    spots = rows.select("core", "ctx", "l", "raw").mapInArrow(tidy(spread), "core long, ctx long, a int, key long")
    twins = spots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return spots.join(twins, "key").groupBy("core", "ctx").agg(F.max("a").alias("most"), F.min("a").alias("least"))


def repeated_spans(docs: DataFrame, ws: Workspace, base: int = BASE, large: int = 50_000, span: int = SPAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copied, spans, shared): contents that several rows have; for each
    other content the byte ranges that are covered by strings of ``span`` bytes found elsewhere; and for each
    content (h1, longest) the greatest common prefix, in bytes of whole phrases, with a neighbour in suffix order;
    prefixes are measured up to the first end of a phrase at ``span`` bytes or more.

    Contents of several rows are one content here; if they have ``span`` bytes or more, all of them repeat.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    # two 64-bit hashes name a content
    hashed = docs.select("doc_id", raw.alias("text"), F.xxhash64(raw).alias("h1"), F.xxhash64(F.lit(1), raw).alias("h2"), F.octet_length(raw).cast("long").alias("n_bytes"))
    digests = ws.save(hashed.drop("text"), "digests")
    content = digests.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.max("n_bytes").alias("n"))
    copied = ws.save(content.where("copies > 1"), "copied")
    size = digests.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = partitions_for(docs.sparkSession, size // (window_of(span) // 2), 1_000_000)
    # of copies, the row with the least doc_id stands for all
    held = hashed.where(F.col("n_bytes") >= span).join(small_side(copied.select("h1", "h2", "first")), ["h1", "h2"], "left").where("first is null or doc_id <=> first").select("h1", "h2", F.col("h1").alias("uid"), "text")
    kept = _phrases(held, buckets, span).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(tidy(_repeated), "uid long, off int, len int, name long")
    kept = ws.save(kept, "kept")
    places = kept.count()
    blocks = partitions_for(docs.sparkSession, places, 500_000)
    string = kept.withColumn("block", F.expr(f"pmod(xxhash64(uid), {blocks})")).groupBy("block").applyInArrow(tidy(lambda rows: _block(rows, span)), "block long, names binary, sizes binary, uids binary, offs binary")
    string = ws.save(string, "string")
    ws.drop("kept")
    ranks = suffix_ranks(string.select("block", "names", "sizes"), ws, base=base, enough=span)
    places = ws.save(_neighbours(string, ranks, places, span), "places")
    spots = _candidates(places).groupBy("uid").agg(F.sort_array(F.collect_list(F.col("off").cast("int"))).alias("offs"), F.max("lcp").alias("longest"))
    spots = ws.save(spots, "spots")
    ws.drop("string")
    contexts = ws.save(_contexts(held.join(_small_lists(spots.select("uid", "offs")), "uid"), False, span), "contexts")
    place = F.struct("h1", "h2", "off")
    groups = contexts.groupBy("core", "ctx").agg(F.min(place).alias("one"), F.max(place).alias("two"), F.first("l").alias("l"), F.first("r").alias("r"))
    groups = ws.save(groups, "groups")
    full = groups.where(f"one != two and l + r >= {span}").select("core", "ctx", F.col("l").alias("lo"), F.col("r").alias("hi"))
    many = groups.groupBy("core").agg(F.count("*").alias("k")).where("k > 1")
    spread = ws.save(groups.join(many, "core").select("core", "ctx", "k", F.col("one.h1").alias("h1"), F.col("one.h2").alias("h2"), F.col("one.off").alias("off")), "open")
    wanted = spread.groupBy(F.col("h1").alias("uid")).agg(F.sort_array(F.collect_set(F.col("off").cast("int"))).alias("offs"))
    shown = _contexts(held.join(_small_lists(ws.save(wanted, "wanted")), "uid"), True, span)
    shown = ws.save(shown.join(spread.select("core", "ctx", "k").distinct(), ["core", "ctx"]).dropDuplicates(["core", "ctx"]), "shown")
    parts = partitions_for(docs.sparkSession, shown.count(), 20_000)
    some = shown.where(F.col("k") <= large).withColumn("chunk", F.expr(f"pmod(xxhash64(core), {parts})"))
    extents = some.groupBy("chunk").applyInArrow(tidy(lambda rows: _extents(rows, span)), "core long, ctx long, most int, least int")
    extents = extents.unionByName(_extents_of_large(shown.where(F.col("k") > large), span))
    partial = extents.select("core", "ctx", F.col("most").alias("lo"), (F.lit(span) - F.col("least")).alias("hi"))
    verdicts = full.unionByName(partial).groupBy("core", "ctx").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    verdicts = small_side(ws.save(verdicts, "verdicts"))
    found = contexts.join(verdicts, ["core", "ctx"]).select("h1", "h2", F.struct((F.col("off") - F.col("lo")).alias("a"), (F.col("off") + F.col("hi")).alias("b")).alias("s"))
    spans = found.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("s")).alias("s")).mapInArrow(_joined, "h1 long, h2 long, spans binary")
    return copied, ws.save(spans, "spans"), spots.select(F.col("uid").alias("h1"), "longest")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ranges of each content as pairs of 64-bit places, those that touch in one."""
    for batch in batches:
        out = []
        for ranges in batch["s"].to_pylist():
            a, b = np.array([(r["a"], r["b"]) for r in ranges], np.int64).T
            b = np.maximum.accumulate(b)
            new = np.append(True, a[1:] > b[:-1])
            out.append(np.stack([a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]], axis=1).tobytes())
        yield pa.RecordBatch.from_arrays([batch["h1"], batch["h2"], pa.array(out, pa.binary())], ["h1", "h2", "spans"])


def _small_lists(lists: DataFrame, most: int = 64 << 20) -> DataFrame:
    """``lists`` (uid, offs) for broadcast if all of them have at most ``most`` bytes."""
    size = lists.agg(F.sum(24 + 4 * F.size("offs"))).first()[0] or 0
    return F.broadcast(lists) if size <= most else lists


def remove_repeats(docs: DataFrame, base: int = BASE, keep: list[str] | None = None, with_text: bool = False, span: int = SPAN) -> DataFrame:
    """doc_id or the ``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256, longest_shared, and with ``with_text`` kept_text.

    Each byte that is covered by a string of ``span`` bytes that also starts anywhere else, in the same
    document or another, is removed; strings never cross documents and are judged on the input.
    kept_text is the rest as text; bytes that a cut character leaves are dropped from it.  longest_shared
    is the longest stretch of whole phrases, in bytes, that a place has in common with one other place, if that
    is RUN bytes or more (else 0), or the longest removed run if that is longer; it tells of repeated passages
    that are too short to be removed.

    A null text is an empty one, from which nothing is removed.  Texts under ``span`` bytes stay whole.
    Repeated rows lose everything from ``span`` bytes on.  No rows give no rows.  Extra columns may have any names.
    """
    ws = Workspace(docs.sparkSession, "repeats")
    keep = keep or ["doc_id"]
    inner = [f"k{i}" for i in range(len(keep))]
    copied, spans, shared = repeated_spans(docs.select("doc_id", "text"), ws, base, span=span)
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, inner, strict=True)), raw.alias("text"), F.xxhash64(raw).alias("h1"), F.xxhash64(F.lit(1), raw).alias("h2"))
    rows = rows.join(small_side(copied.select("h1", "h2", "copies")), ["h1", "h2"], "left")
    rows = rows.join(small_side(spans), ["h1", "h2"], "left").join(small_side(shared), "h1", "left")
    fields = [*(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, inner, strict=True)), "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", "longest_shared long", "kept_text string"]
    names = [f.split()[0] for f in fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copies, spans, longest in zip(batch["text"].cast(pa.binary()), *(batch[c].to_pylist() for c in ("copies", "spans", "longest")), strict=True):
                data = text.as_py()
                n = len(data)
                ranges = [(0, n)] if copies is not None and n >= span else np.frombuffer(spans or b"", np.int64).reshape(-1, 2).tolist()
                kept, at, removed = [], 0, 0
                for a, b in ranges:
                    kept.append(data[at:a])
                    removed, at = removed + b - a, b
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((n, removed, len(ranges), hashlib.sha256(rest).hexdigest(), n if ranges == [(0, n)] else max(longest or 0, max((b - a for a, b in ranges), default=0)), rest.decode("utf-8", "ignore") if with_text else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in inner), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    out = rows.select(*inner, "text", "copies", "spans", "longest").mapInArrow(tidy(cut), ", ".join(fields))
    tail = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "longest_shared", *(["kept_text"] if with_text else [])]
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)), *tail)
