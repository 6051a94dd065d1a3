"""Brown class-based bigram scores: exchange clustering of words, class transitions and word emissions.

Words that make up at least a share of the training tokens, a bounded number of them, exchange classes by
the counts of all pairs of them.  Every other training word, however rare, then takes the class that its
own neighbours make most likely; that is done where the word's count is, so nothing grows on the driver.
Class pairs are counted over all training texts with the classes of all words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .workspace import Workspace, partitions_for, tidy

#: Stands for the end of a text among word hashes.
END = np.uint64(1)
_HELD = 2_000_000


def _tokens(docs: textkit.Docs) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words with an end behind each document, and where documents begin."""
    begins, ends, first = docs.words()
    words = textkit.spans(docs.prefix(lower=True), begins, ends)
    n = len(docs)
    out = np.full(len(words) + n, END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))] = words
    return out, first + np.arange(n + 1)


class _Counter:
    """Counts of 64-bit keys, merged as they grow."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.waiting.append((keys, counts))
        if sum(len(k) for k, _ in self.waiting) > max(_HELD, len(self.keys)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.waiting = []
        return self.keys, self.counts


def _dealt(keys: np.ndarray, counts: np.ndarray, part: np.ndarray, parts: int) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    own = [(b, order[cut[b] : cut[b + 1]]) for b in range(parts) if cut[b] < cut[b + 1]]
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in own], pa.int32()), pa.array([keys[at].tobytes() for _, at in own], pa.binary()), pa.array([counts[at].astype(np.int64).tobytes() for _, at in own], pa.binary())],
        ["bucket", "keys", "counts"],
    )


def _merged(rows: pa.Table) -> pa.Table:
    c = _Counter()
    for k, n in zip(rows["keys"].to_pylist(), rows["counts"].to_pylist(), strict=True):
        c.add(np.frombuffer(k, np.uint64), np.frombuffer(n, np.int64))
    keys, counts = c.merge()
    return pa.table({"bucket": rows["bucket"][:1], "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "n": pa.array([int(counts.sum())]), "v": pa.array([len(keys)])})


_MERGED = "bucket int, keys binary, counts binary, n long, v long"


def word_counts(train: DataFrame, buckets: int) -> DataFrame:
    """Counts of all tokens of ``train``, one row of sorted hashes and counts for each bucket of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _Counter()
        for batch in batches:
            for docs in textkit.slices(batch["text"]):
                c.add(_tokens(docs)[0])
        keys, counts = c.merge()
        yield _dealt(keys, counts, (keys % np.uint64(buckets)).astype(np.int64), buckets)

    return train.select("text").mapInArrow(count, "bucket int, keys binary, counts binary").groupBy("bucket").applyInArrow(_merged, _MERGED)


@dataclass
class Core:
    """Words that exchanged classes, and what is known of classes then; the last class is that of all other words."""

    words: np.ndarray  # sorted hashes, at most 1 / share
    classes: np.ndarray
    log: np.ndarray  # log P(class | class before)
    sizes: np.ndarray  # tokens of each class

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and whether it has exchanged."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        return np.where(known, self.classes[at], len(self.sizes) - 1), known


def _transitions(pairs: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """P(class | class before), smoothed towards the classes' own shares, which weigh as much as ``kinds``."""
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + pairs.shape[1])
    return (pairs + (kinds[:, None] + 1) * share) / (pairs.sum(axis=1, keepdims=True) + kinds[:, None] + 1)


def _pack(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, the first bytes of all before the second ones, compressed."""
    x = x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)
    return bytes([x.itemsize]) + pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(x: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(x[1:], decompressed_size=n * x[0], codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(x[0], n).T).view(f"u{x[0]}").ravel().astype(np.int64)


def _sums(found: DataFrame, n: int) -> np.ndarray:
    """Totals of (cell, x): ``n`` numbers."""
    out = np.zeros(n)
    for r in found.groupBy("cell").agg(F.sum("x").alias("x")).collect():
        out[r.cell] = r.x
    return out


def _cells(out: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(out)
    return pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some].astype(np.int64))], ["cell", "x"])


def learn_core(train: DataFrame, counts: DataFrame, ws: Workspace, classes: int = 96, share: float = 1 / 32768, sweeps: int = 8) -> Core:
    """Exchange clustering: each sweep moves words to the class at which the likelihood of all pairs is greatest.

    Words of at least ``share`` of the tokens take part.  Sweeps see fixed class counts and move one half
    of the words in turn, so that a sweep runs in parallel over words.  The end of a text has a class of
    its own, and so have all other words for now.
    """
    spark = train.sparkSession
    tokens = int(counts.agg(F.sum("n")).first()[0] or 0)
    buckets = partitions_for(spark, tokens, 5_000_000)
    least = max(1, tokens * share)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                k, n = np.frombuffer(k, np.uint64), np.frombuffer(n, np.int64)
                some = (n >= least) | (k == END)
                yield pa.RecordBatch.from_arrays([pa.array(k[some].astype(np.int64)), pa.array(n[some])], ["word", "n"])

    found = {r.word: r.n for r in counts.select("keys", "counts").mapInArrow(frequent, "word long, n long").collect()}  # 1/share words at most
    found.setdefault(int(END), 0)
    words = np.array(list(found), np.int64).astype(np.uint64)
    order = np.argsort(words)
    words, number = words[order], np.array(list(found.values()), np.int64)[order]
    k = len(words)
    sizes = np.append(number, tokens - number.sum()).astype(np.float64)
    end = int(np.searchsorted(words, END))
    known = spark.sparkContext.broadcast(words)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, c = known.value, _Counter()
        for batch in batches:
            for docs in textkit.slices(batch["text"]):
                seq = _tokens(docs)[0]
                at = np.minimum(np.searchsorted(w, seq), k - 1)
                ids = np.where(w[at] == seq, at, k).astype(np.uint64)
                c.add(np.append(np.uint64(end), ids[:-1]) * np.uint64(k + 1) + ids)
        keys, n = c.merge()
        yield _dealt(keys, n, (keys // np.uint64(k + 1) % np.uint64(buckets)).astype(np.int64), buckets)

    dealt = "bucket int, keys binary, counts binary"
    right = train.select("text").mapInArrow(tidy(pairs), dealt).groupBy("bucket").applyInArrow(tidy(_merged), _MERGED)
    right = ws.save(right, "pairs")

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, n in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                x, n = np.frombuffer(x, np.uint64), np.frombuffer(n, np.int64)
                a, b = x // np.uint64(k + 1), x % np.uint64(k + 1)
                yield _dealt(b * np.uint64(k + 1) + a, n, (b % np.uint64(buckets)).astype(np.int64), buckets)

    left = right.select("keys", "counts").mapInArrow(turned, dealt).groupBy("bucket").applyInArrow(tidy(_merged), _MERGED)
    left = left.select("bucket", F.col("keys").alias("lkeys"), F.col("counts").alias("lcounts"))
    both = ws.save(right.select("bucket", "keys", "counts").join(left, "bucket", "full").repartition(buckets, "bucket"), "contexts")
    ws.drop("pairs")

    # the most frequent words start in classes of their own, the others in turn
    cls = np.zeros(k + 1, np.int64)
    cls[np.argsort(-number, kind="stable")] = np.arange(k) % (classes - 2) + 1
    cls[end], cls[k] = 0, classes - 1
    strength = np.full(classes, 9.0)

    def class_pairs(cls: np.ndarray) -> np.ndarray:
        now = spark.sparkContext.broadcast(cls)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, out = now.value, np.zeros(classes * classes)
            for batch in batches:
                for x, n in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                    if x:
                        x = np.frombuffer(x, np.uint64).astype(np.int64)
                        out += np.bincount(c[x // (k + 1)] * classes + c[x % (k + 1)], np.frombuffer(n, np.int64), classes * classes)
            yield _cells(out)

        return _sums(both.select("keys", "counts").mapInArrow(tidy(add), "cell long, x long"), classes * classes).reshape(classes, classes)

    for sweep in range(sweeps):
        state = spark.sparkContext.broadcast((cls, class_pairs(cls)))

        def move(batches: Iterator[pa.RecordBatch], sweep: int = sweep, state=state) -> Iterator[pa.RecordBatch]:
            c, m = state.value
            log = np.log(_transitions(m, strength))
            size = np.bincount(c, sizes, classes)
            for batch in batches:
                for b, x, n, y, o in zip(*(batch[f].to_pylist() for f in ("bucket", "keys", "counts", "lkeys", "lcounts")), strict=True):
                    own = np.arange(b, k, buckets)
                    if not len(own):
                        continue
                    score = np.zeros((len(own), classes))
                    for pairs, count, table in ((x, n, log.T), (y, o, log)):
                        if not pairs:
                            continue
                        pairs = np.frombuffer(pairs, np.uint64).astype(np.int64)
                        w, other = pairs // (k + 1), c[pairs % (k + 1)]
                        ok = w < k
                        near = np.bincount((w[ok] // buckets) * classes + other[ok], np.frombuffer(count, np.int64)[ok], len(own) * classes)
                        score += near.reshape(len(own), classes) @ table
                    inside = np.zeros((len(own), classes))
                    inside[np.arange(len(own)), c[own]] = 1
                    score -= sizes[own, None] * np.log(size[None, :] + (1 - inside) * sizes[own, None] + 1)
                    score[:, [0, classes - 1]] = -np.inf
                    best = score.argmax(axis=1)
                    turn = (own // buckets + sweep) % 2 == 0
                    turn &= (own != end) & (best != c[own])
                    yield pa.RecordBatch.from_arrays([pa.array(own[turn]), pa.array(best[turn])], ["word", "class"])

        moves = both.mapInArrow(move, "word long, class long").collect()  # 1/share words at most
        cls = cls.copy()
        cls[[r.word for r in moves]] = [r["class"] for r in moves]
        if not moves and sweep:
            break
    log = np.log(_transitions(class_pairs(cls), strength))
    ws.drop("contexts")
    ws.release()
    return Core(words, cls[:k], log, np.bincount(cls, sizes, classes))


#: Marks the class of a word that did not exchange.
_RARE = 128
HELD_TOKENS = 600_000


def _asked(docs: DataFrame, core, buckets: int) -> DataFrame:
    """Parts of the texts: documents as places among the part's different words (kind 0), and those words by bucket (kind 1).

    With each word that did not exchange go the classes before and behind it in training texts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"kind int, part long, doc_id {kind}, held_out boolean, n_tokens long, seq binary, bucket int, words binary, runs binary, near binary"
    names = [f.split()[0] for f in fields.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, task, flush, held = core.value, TaskContext.get().partitionId(), 0, []

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal flush
            if not held:
                return
            part, flush = (task << 32) + flush, flush + 1
            length = np.concatenate([np.diff(first) for _, first, _ in held])
            words, ids = np.unique(np.concatenate([seq for seq, _, _ in held]), return_inverse=True)
            own = pa.Table.from_batches([rows for _, _, rows in held]).combine_chunks()
            held.clear()
            deal = (words % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(deal, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            ids, words, deal = place[ids], words[order], deal[order]
            first = np.cumsum(length) - length
            cls, core_word = c.of(words)
            near = cls[ids].astype(np.uint8)
            before = np.append(np.uint8(0), near[:-1])
            before[first] = 0
            teaches = ~np.repeat(own["held_out"].to_numpy(), length) & ~core_word[ids]
            at = np.flatnonzero(teaches)
            at = at[np.argsort(ids[at], kind="stable")]
            runs = np.bincount(ids[at], minlength=len(words))
            sides = np.stack([before[at], near[np.minimum(at + 1, len(near) - 1)]])
            n, small = len(length), ids.astype(np.uint16) if len(words) <= 1 << 16 else ids.astype(np.uint32)
            seqs = [small[a : a + k].tobytes() for a, k in zip(first.tolist(), length.tolist(), strict=True)]
            none = pa.nulls(n, pa.binary())
            cols = [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part)), own["doc_id"].combine_chunks(), own["held_out"].combine_chunks(), pa.array(length), pa.array(seqs, pa.binary()), pa.nulls(n, pa.int32()), none, none, none]
            yield pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in cols], names)
            edge = np.searchsorted(deal, np.arange(buckets + 1))
            upto = np.append(0, np.cumsum(runs))
            rows = [(b, words[i:j].tobytes(), _pack(runs[i:j]), _pack(sides[:, upto[i] : upto[j]].ravel())) for b, i, j in zip(range(buckets), edge[:-1].tolist(), edge[1:].tolist(), strict=True) if i < j]
            r = len(rows)
            b, w, k, s = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(r, np.int32)), pa.array(np.full(r, part)), pa.nulls(r, own.schema.field("doc_id").type), pa.nulls(r, pa.bool_()), pa.nulls(r, pa.int64()), pa.nulls(r, pa.binary()), pa.array(b, pa.int32()), *(pa.array(x, pa.binary()) for x in (w, k, s))], names)

        waiting = 0
        for batch in batches:
            for d in textkit.slices(batch["text"]):
                seq, first = _tokens(d)
                rows = batch.select(["doc_id", "held_out"]).slice(d.first, len(d))
                held.append((seq, first, rows))
                waiting += len(seq)
                if waiting > HELD_TOKENS:
                    yield from flushed()
                    waiting = 0
        yield from flushed()

    return docs.mapInArrow(tidy(cut), fields)


def class_of_each(keys: np.ndarray, counts: np.ndarray, core: Core, at: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Classes of the words ``keys``: their own, or the most likely one by the classes around them at places ``at``."""
    cls, known = core.of(keys)
    classes = len(core.sizes)
    rest = np.flatnonzero(~known)
    rank = np.full(len(keys), -1)
    rank[rest] = np.arange(len(rest))
    order = np.argsort(rank[at], kind="stable")
    at, before, behind = rank[at][order], before[order].astype(np.int64), behind[order].astype(np.int64)
    for lo in range(0, len(rest), 10_000):
        own = rest[lo : lo + 10_000]
        i, j = np.searchsorted(at, [lo, lo + len(own)])
        score = np.zeros((len(own), classes))
        for other, table in ((behind, core.log.T), (before, core.log)):
            score += np.bincount((at[i:j] - lo) * classes + other[i:j], minlength=len(own) * classes).reshape(-1, classes) @ table
        score -= counts[own, None] * np.log(core.sizes[None, :] + counts[own, None] + 1)
        score[:, [0, classes - 1]] = -np.inf
        cls[own] = score.argmax(axis=1) | _RARE
    return cls.astype(np.uint8)


def class_lm_scores(docs: DataFrame, held_out, classes: int = 96, share: float = 1 / 32768, sweeps: int = 8, docs_per_bucket: int = 10_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    ``held_out`` is a boolean column of ``docs``; rows where it is true teach nothing.  Tokens are words
    cut at ASCII white space, with A-Z lower-cased, and one end.  base_score is the add-one unigram's
    log10 probability, score the class model's: each token's class given the class before, and the token
    given its class.  There are at most 128 classes; the first is the end's, the last that of unknown words,
    which are as likely as by base_score.  Behind any class, the probabilities of all known words and of an
    unknown one add up to 1.  Each part of the texts looks its different words up where their counts are.

    A null or empty text is an end alone.  Repeated rows are scored alike; with no training rows every
    word is unknown.  Rows without doc_id are scored like others.  No rows give no rows.  Columns other
    than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "class_lm")
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = docs.where(~F.col("held_out"))
    buckets = partitions_for(spark, train.count(), docs_per_bucket)
    counts = ws.save(word_counts(train, buckets), "counts")
    total = counts.agg(F.sum("n"), F.sum("v")).first()
    tokens, distinct = int(total[0] or 0), int(total[1] or 0)
    core = spark.sparkContext.broadcast(learn_core(train, counts, ws, classes, share, sweeps))  # 1/share words, classes x classes numbers
    kind = docs.schema["doc_id"].dataType.simpleString()
    base_floor = np.log10(tokens + distinct + 1)
    parts = ws.save(_asked(docs, core, buckets), "parts")

    def look_up(asked: pa.Table, own: pa.Table) -> pa.Table:
        known = len(own) > 0
        keys = np.frombuffer(own["keys"][0].as_py(), np.uint64) if known else np.zeros(0, np.uint64)
        number = np.frombuffer(own["counts"][0].as_py(), np.int64) if known else np.zeros(0, np.int64)
        at, where, before, behind = [], [], [], []
        for w, runs, near in zip(*(asked[c].to_pylist() for c in ("words", "runs", "near")), strict=True):
            w = np.frombuffer(w, np.uint64)
            i = np.minimum(np.searchsorted(keys, w), max(len(keys) - 1, 0))
            at.append(np.where(keys[i] == w, i, len(keys)) if len(keys) else np.zeros(len(w), np.int64))
            runs = _unpack(runs, len(w))
            sides = _unpack(near, 2 * int(runs.sum())).astype(np.uint8).reshape(2, -1)
            where.append(np.repeat(at[-1], runs))
            before.append(sides[0])
            behind.append(sides[1])
        cls = np.zeros(0, np.uint8)
        if len(keys):
            cls = class_of_each(keys, number, core.value, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (where, before, behind)))
        members = np.bincount(cls & (_RARE - 1), minlength=classes)
        number, cls = np.append(number, 0), np.append(cls, np.uint8(classes - 1))
        r = len(asked)
        return pa.table({
            "part": pa.concat_arrays([asked["part"].combine_chunks() if r else pa.array([], pa.int64()), pa.nulls(1, pa.int64())]),
            "bucket": pa.array([*asked["bucket"].to_pylist(), None], pa.int32()),
            "n": pa.array([*(_pack(number[i]) for i in at), None], pa.binary()),
            "classes": pa.array([*(cls[i].tobytes() for i in at), None], pa.binary()),
            "members": pa.array([None] * r + [members.astype(np.int64).tobytes()], pa.binary()),
        })

    asked = parts.where("kind = 1").select("part", "bucket", "words", "runs", "near").groupBy("bucket")
    found = asked.cogroup(counts.select("bucket", "keys", "counts").groupBy("bucket")).applyInArrow(tidy(look_up), "part long, bucket int, n binary, classes binary, members binary")
    found = ws.save(found, "found")
    members = np.zeros(classes)
    for r in found.where("members is not null").select("members").collect():  # a row a bucket
        members += np.frombuffer(r.members, np.int64)

    def complete(rows: pa.Table, more: pa.Table) -> pa.Table:
        answers = sorted(zip(more["bucket"].to_pylist(), more["n"].to_pylist(), more["classes"].to_pylist(), strict=True))
        cls = np.frombuffer(b"".join(c for _, _, c in answers), np.uint8)
        n = np.concatenate([_unpack(x, len(c)) for _, x, c in answers])
        length = rows["n_tokens"].to_numpy()
        seq = np.frombuffer(b"".join(rows["seq"].to_pylist()), np.uint16 if len(cls) <= 1 << 16 else np.uint32)
        first = np.append(0, np.cumsum(length)[:-1])
        own = [(n > 0).astype(np.int64), np.log10(n + 1) - base_floor, np.where(n > 0, np.log10(n + 0.5), 0.0)]
        known, base, logs = (np.add.reduceat(x[seq], first) for x in own)
        kinds = cls[seq]
        return pa.table({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": rows["n_tokens"], "n_known": known, "base_score": base, "logs": logs, "classes": pa.array([kinds[a : a + k].tobytes() for a, k in zip(first.tolist(), length.tolist(), strict=True)], pa.binary())})

    whole = parts.where("kind = 0").select("part", "doc_id", "held_out", "n_tokens", "seq").groupBy("part")
    coded = whole.cogroup(found.where("part is not null").groupBy("part")).applyInArrow(tidy(complete), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, logs double, classes binary")
    coded = ws.save(coded, "coded")
    ws.drop("parts", "found", "counts")
    transitions, sizes = class_tables(coded.where(~F.col("held_out")), classes, tokens + distinct + 1)
    room = np.log10(np.maximum(sizes + 0.5 * members, 1e-9))
    room[-1] = 0.0
    table = spark.sparkContext.broadcast((transitions, room))  # classes x classes numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, size = table.value
        for batch in batches:
            length = batch["n_tokens"].to_numpy()
            if not len(length):
                continue
            before, c, first, _ = _pairs_of(batch)
            got = np.add.reduceat(log[before, c] - size[c], first) + batch["logs"].to_numpy()
            n = len(length)
            cols = [*(batch[x] for x in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(n, tokens, np.int64)), batch["base_score"], pa.array(got)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(tidy(score), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _pairs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class before and class of each token, where documents start, and whether a word beside or itself did not exchange."""
    length = batch["n_tokens"].to_numpy()
    raw = np.frombuffer(b"".join(batch["classes"].to_pylist()), np.uint8)
    first = np.cumsum(length) - length
    c = (raw & (_RARE - 1)).astype(np.int64)
    rare = raw >= _RARE
    before, rare_before = np.append(0, c[:-1]), np.append(False, rare[:-1])
    before[first], rare_before[first] = 0, False
    return before, c, first, rare | rare_before


def class_tables(coded: DataFrame, classes: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(log10 P(class | class before), tokens of each class) from training texts; the last class is that of unknown words.

    A pair with a word that did not exchange is as good as seen once, and that word's class fits this
    pair; so the classes' own shares weigh as much as there are such pairs in a row.
    """
    cells = classes * classes

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * cells)
        for batch in batches:
            if batch.num_rows:
                before, c, _, rare = _pairs_of(batch)
                out[:cells] += np.bincount(before * classes + c, minlength=cells)
                out[cells:] += np.bincount(before[rare] * classes + c[rare], minlength=cells)
        yield _cells(out)

    pairs, loose = _sums(coded.select("n_tokens", "classes").mapInArrow(tidy(add), "cell long, x long"), 2 * cells).reshape(2, classes, classes)
    p = _transitions(pairs[:, :-1], loose.sum(axis=1)) * (1 - 1 / words)
    return np.log10(np.maximum(np.append(p, np.full((classes, 1), 1 / words), axis=1), 1e-300)), pairs.sum(axis=0)


def class_lm_scores_of_documents(docs: DataFrame, modulus: int = 7, rest: int = 2) -> DataFrame:
    """Scores of all rows; learns from those whose crc32(doc_id as text) mod ``modulus`` is not ``rest``."""
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return class_lm_scores(docs, key % modulus == rest)
