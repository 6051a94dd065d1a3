"""Removal of passages that a document with a smaller doc_id has, too: confirmed phrases, sharded automata, streamed texts.

A phrase is a window of ``WORDS`` consecutive words.  Its anchor is the leftmost of its ``GRAM``-word runs
of the least hash, so equal windows have equal anchors, and about one run in five is an anchor.  Windows
whose anchor is in one document only occur once and go.  Around each anchor that is left, the words of
all windows that share it are one stretch.  Stretches are dealt over shards by their anchor.  Windows
are confirmed word by word: those that two documents have are the phrases.  An Aho-Corasick automaton is
compiled of each shard's phrases, and the stretches of all documents that have its anchors are streamed
through it, which finds every place of every phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import textkit
from .workspace import Workspace, partitions_for, small_side, tidy

WORDS, GRAM = 13, 5
#: Stretches that one automaton is meant for, and above which those of one anchor are split.
SHARD = 20_000


def anchors(d: textkit.Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, first word, number of words, place of the anchor) of each stretch of windows that share an anchor, in order."""
    starts, ends, first = d.words()
    m = len(starts) - WORDS + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 5
    gram = textkit.grams(textkit.spans(d.prefix(), starts, ends), GRAM)
    at = np.lib.stride_tricks.sliding_window_view(gram, WORDS - GRAM + 1).argmin(axis=1) + np.arange(m)
    owner = np.repeat(np.arange(len(d)), np.diff(first))
    window = np.flatnonzero(owner[:m] == owner[WORDS - 1 :])  # windows that cross no border
    if not len(window):
        return (np.zeros(0, np.int64),) * 5
    at, who = at[window], owner[window]
    head = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (who[1:] != who[:-1])))
    count = np.diff(np.append(head, len(at)))
    return who[head], gram[at[head]].astype(np.int64), window[head] - first[who[head]], count + WORDS - 1, at[head] - window[head]


def _anchored(docs: DataFrame) -> DataFrame:
    """(hash, h1, h2, doc, at, size, place) of all stretches of ``docs`` (h1, h2, doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch[c].to_numpy() for c in ("h1", "h2", "doc")]
            for d in textkit.slices(batch["text"]):
                who, h, at, size, place = anchors(d)
                cols = [h, *(x[d.first + who] for x in own), at.astype(np.int32), size.astype(np.int8), place.astype(np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["hash", "h1", "h2", "doc", "at", "size", "place"])

    return docs.select("h1", "h2", "doc", "text").mapInArrow(tidy(run), "hash long, h1 long, h2 long, doc long, at int, size byte, place byte")


#: One stretch in a packed list: first word, number of words, place of the anchor, shards of the anchor.
_PLACE = np.dtype([("at", "<i4"), ("size", "i1"), ("place", "i1"), ("parts", "<i4")])


def _packed(lists: DataFrame) -> DataFrame:
    """``lists`` (h1, h2, doc, s) with s in ten bytes a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, out = batch["s"], []
            inner = [s.values.field(c).to_numpy() for c in _PLACE.names]
            ends = s.offsets.to_numpy()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                row = np.empty(b - a, _PLACE)
                for c, x in zip(_PLACE.names, inner, strict=True):
                    row[c] = x[a:b]
                out.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("h1", "h2", "doc")), pa.array(out, pa.binary())], ["h1", "h2", "doc", "s"])

    return lists.mapInArrow(tidy(run), "h1 long, h2 long, doc long, s binary")


def _stretches(docs: DataFrame) -> DataFrame:
    """(hash, h1, h2, doc, at, words, parts): the words of the stretches that ``docs`` (h1, h2, doc, text, s) list, and a hash of the anchor's."""
    fields = "hash long, h1 long, h2 long, doc long, at int, words string, parts int"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h1, h2, doc, text, raw in zip(*(batch[c] for c in ("h1", "h2", "doc", "text", "s")), strict=True):
                words = text.as_py().encode().split()  # at the six white-space characters of ASCII
                listed = np.frombuffer(raw.as_py(), _PLACE)
                n, begin, place = len(listed), listed["at"].astype(np.int64), listed["place"].astype(np.int64)
                key = [xxh64_intdigest(b" ".join(words[p : p + GRAM])) for p in (begin + place).tolist()]
                cut = [b" ".join(words[a:b]).decode() for a, b in zip(begin.tolist(), (begin + listed["size"]).tolist(), strict=True)]
                own = [pa.array(np.full(n, v.as_py(), np.int64)) for v in (h1, h2, doc)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(key, np.uint64).astype(np.int64)), *own, pa.array(begin.astype(np.int32)), pa.array(cut, pa.string()), pa.array(listed["parts"].copy())], names)

    return docs.select("h1", "h2", "doc", "text", "s").mapInArrow(tidy(run), fields)


def confirmed_phrases(stretches: DataFrame) -> DataFrame:
    """(hash, phrase, first, parts): windows that documents of two or more doc_ids have, and the smallest of these.

    Equal stretches are one before their windows are taken apart, and equal windows are counted where they
    are, so a phrase that a third of all documents have is a row for each task.
    """
    each = stretches.groupBy("hash", "words").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.first("parts").alias("parts")).withColumn("w", F.split("words", " "))
    window = F.expr(f"explode(transform(sequence(0, size(w) - {WORDS}), i -> array_join(slice(w, i + 1, {WORDS}), ' ')))")
    found = each.select("hash", window.alias("phrase"), "lo", "hi", "parts").groupBy("hash", "phrase").agg(F.min("lo").alias("first"), F.max("hi").alias("last"), F.first("parts").alias("parts"))
    return found.where("first < last").select("hash", "phrase", "first", "parts")


class Automaton:
    """Phrases of one shard; each different word of theirs is one letter, so a place is a place of a word."""

    def __init__(self, phrases: list[str], values: list[int]):
        self._letters: dict[str, str] = {}
        self._found = ahocorasick.Automaton()
        for phrase, value in zip(phrases, values, strict=True):
            self._found.add_word("".join(map(self._letter, phrase.split(" "))), value)
        if phrases:
            self._found.make_automaton()

    def _letter(self, word: str) -> str:
        letter = self._letters.get(word)
        if letter is None:
            n = len(self._letters) + 1
            letter = self._letters[word] = chr(n if n < 0xD800 else n + 0x800)  # surrogates are no letters
        return letter

    def places(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(first word, value) of each phrase in a run of words."""
        if len(self._found):
            known = self._letters.get
            for end, value in self._found.iter("".join([known(w, "\0") for w in words])):
                yield end - WORDS + 1, value


def _confirmed(docs: list[int], stretches: list[list[str]]) -> dict[str, int]:
    """Windows that two of the documents have, and the smallest document of each."""
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for doc, words in zip(docs, stretches, strict=True):
        for i in range(len(words) - WORDS + 1):
            phrase = " ".join(words[i : i + WORDS])
            if doc < first.get(phrase, doc + 1):
                first[phrase] = doc
            if doc > last.get(phrase, doc - 1):
                last[phrase] = doc
    return {phrase: doc for phrase, doc in first.items() if doc < last[phrase]}


def _located(phrases: pa.Table, stretches: pa.Table) -> pa.Table:
    """(h1, h2, a, b): runs of words in the shard's stretches that phrases of smaller doc_ids cover.

    Phrases of anchors that are whole in the shard are confirmed here, those of split anchors come with it.
    """
    h1, h2, docs, at, words, split = (stretches[c].to_pylist() for c in ("h1", "h2", "doc", "at", "words", "split"))
    cut = [w.split(" ") for w in words]
    own = [i for i, x in enumerate(split) if not x]
    known = _confirmed([docs[i] for i in own], [cut[i] for i in own])
    automaton = Automaton([*known, *phrases["phrase"].to_pylist()], [*known.values(), *phrases["first"].to_pylist()])
    rows = []
    for i, doc in enumerate(docs):
        a = b = -1
        for place, first in automaton.places(cut[i]):
            if first < doc:
                if place > b:
                    if b > 0:
                        rows.append((h1[i], h2[i], at[i] + a, at[i] + b))
                    a = place
                b = place + WORDS
        if b > 0:
            rows.append((h1[i], h2[i], at[i] + a, at[i] + b))
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("h1", "h2", "a", "b"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)})


def _occurrences(stretches: DataFrame, shard: int) -> DataFrame:
    """(h1, h2, a, b) of all phrases in all stretches.

    A shard has all stretches of some anchors.  Those of an anchor with more than ``shard``, which each of them tells by its
    ``parts``, are split among several shards; its phrases are confirmed beforehand, window by window in Spark, and each of
    its shards gets them.
    """
    shards = partitions_for(stretches.sparkSession, stretches.count(), shard)
    of = lambda part: F.expr(f"pmod(xxhash64(hash, {part}), {shards})").alias("shard")
    left = confirmed_phrases(stretches.where("parts > 1")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = stretches.withColumn("part", F.expr("cast(pmod(xxhash64(h1, h2), parts) as int)"))
    left, right = left.select(of("part"), "phrase", "first"), right.select(of("part"), "h1", "h2", "doc", "at", "words", (F.col("parts") > 1).alias("split"))
    return left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(tidy(_located), "h1 long, h2 long, a int, b int")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ranges of words as pairs of 32-bit places, those that touch in one."""
    for batch in batches:
        out, s = [], batch["s"]
        a, b = s.values.field("a").to_numpy(), s.values.field("b").to_numpy()
        ends = s.offsets.to_numpy()
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            begin, stop = a[lo:hi], np.maximum.accumulate(b[lo:hi])
            new = np.append(True, begin[1:] > stop[:-1])
            out.append(np.stack([begin[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]], axis=1).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch["h1"], batch["h2"], pa.array(out, pa.binary())], ["h1", "h2", "spans"])


def covered_words(docs: DataFrame, ws: Workspace, shard: int = SHARD) -> DataFrame:
    """(h1, h2, first, spans): of each content of ``docs`` (doc_id, text, h1, h2) its smallest doc_id and the word
    ranges that phrases of documents with smaller doc_ids cover; contents without such ranges have null spans.
    """
    content = ws.save(docs.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("n")), "contents")
    # of copies, the row with the least doc_id stands for all; contents that one row has need not be looked up
    several = small_side(content.where("n > 1").select("h1", "h2", "first"))
    held = docs.where("doc_id is not null").join(several, ["h1", "h2"], "left").where("first is null or doc_id = first").select("h1", "h2", F.col("doc_id").alias("doc"), "text")
    anchored = ws.save(_anchored(held), "anchors")
    again = anchored.groupBy("hash").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.ceil(F.count("*") / shard).cast("int").alias("parts")).where("lo < hi").select("hash", "parts")
    again = small_side(ws.save(again, "again"))
    lists = anchored.join(again, "hash").groupBy("h1", "h2", "doc").agg(F.collect_set(F.struct(*_PLACE.names)).alias("s"))
    lists = ws.save(_packed(lists), "lists")
    ws.drop("anchors")
    ws.release()
    stretches = ws.save(_stretches(held.join(lists, ["h1", "h2", "doc"])), "stretches")
    ws.drop("lists")
    ws.release()
    found = _occurrences(stretches, shard)
    found = found.groupBy("h1", "h2").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("s")).mapInArrow(_joined, "h1 long, h2 long, spans binary")
    found = ws.save(found, "found")
    ws.drop("stretches")
    copied = content.where("n > 1").select("h1", "h2", "first")
    return copied.join(found, ["h1", "h2"], "full_outer")


def remove_earlier_phrases(docs: DataFrame, keep: list[str] | None = None, with_text: bool = False, shard: int = SHARD) -> DataFrame:
    """``keep`` columns (doc_id), n_words, n_removed, kept_sha256 and, with ``with_text``, kept_text; one row for each input row.

    Words are the runs of other characters than the six white-space characters of ASCII, unchanged.  A word
    goes if a window of WORDS (13) words covers it that also starts in a document of a smaller doc_id.  Windows
    are judged on the input.  kept_text is the rest with single spaces.

    A null or empty text has no words; texts of fewer than WORDS words stay whole.  Rows of equal doc_id take
    nothing from each other, and fare alike if their texts are equal.  A row without doc_id has no order: it keeps all
    and takes nothing.  doc_id must be an integer.  No rows give no rows.  Extra columns may have any names.
    """
    ws = Workspace(docs.sparkSession, "phrases")
    keep = keep or ["doc_id"]
    inner = [f"k{i}" for i in range(len(keep))]
    raw = F.coalesce(F.col("text"), F.lit(""))
    key = [F.xxhash64(raw).alias("h1"), F.xxhash64(F.lit(1), raw).alias("h2")]
    spans = ws.save(covered_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("text"), *key), ws, shard), "spans")
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, inner, strict=True)), F.col("doc_id").cast("long").alias("doc"), raw.alias("text"), *key)
    rows = rows.join(small_side(spans), ["h1", "h2"], "left")
    fields = [*(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, inner, strict=True)), "n_words long", "n_removed long", "kept_sha256 string", "kept_text string"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, doc, first, spans in zip(batch["text"], *(batch[c].to_pylist() for c in ("doc", "first", "spans")), strict=True):
                words = text.as_py().encode().split()
                n, kept, at = len(words), [], 0
                if doc is not None and first is not None and doc > first and n >= WORDS:
                    ranges = [(0, n)]  # a copy has it all
                else:
                    ranges = np.frombuffer(spans or b"", np.int32).reshape(-1, 2).tolist() if doc is not None else []
                for a, b in ranges:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rest = b" ".join(kept)
                out.append((n, n - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode() if with_text else None))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in inner), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [f.split()[0] for f in fields])

    out = rows.select(*inner, "text", "doc", "first", "spans").mapInArrow(tidy(cut), ", ".join(fields))
    tail = ["n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, inner, strict=True)), *tail)
