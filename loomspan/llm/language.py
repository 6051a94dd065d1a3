"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import tidy

SIZES = (1, 2, 3)
#: Rows that a task holds as Python objects at a time.
ROWS = 500
_BITS = 18  # the largest code point of a letter fits


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> code point of its lower-case letter, 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(1 << _BITS):
        if (s := chr(c)).isalpha():
            table[c] = ord(low) if len(low := s.lower()) == 1 else c
    return table


def ngrams(text: str) -> np.ndarray:
    """Keys of all 1- to 3-grams; other characters than letters act as one space, also at both ends."""
    codes = _letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))].astype(np.uint64)
    out = [codes[codes != 0] | np.uint64(1 << 3 * _BITS)]
    key = codes
    for n in SIZES[1:]:
        key = (key[:-1] << np.uint64(_BITS)) | codes[n - 1 :]
        out.append(key | np.uint64(n << 3 * _BITS))
    return np.concatenate(out)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys = all_keys[order]
    first = np.flatnonzero(np.append(True, all_keys[1:] != all_keys[:-1])) if len(all_keys) else np.zeros(0, int)
    return all_keys[first], np.add.reduceat(all_counts[order], first) if len(first) else all_counts[:0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of a partition by language, merged as they grow."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            part = np.unique(ngrams(text.as_py()), return_counts=True)
            held.setdefault(lang, []).append(part)
            waiting[lang] = waiting.get(lang, 0) + len(part[0])
            if waiting[lang] > 1_000_000:
                held[lang] = [_merge(*map(list, zip(*held[lang], strict=True)))]
                waiting[lang] = 0
    for lang, parts in held.items():
        keys, counts = _merge(*map(list, zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def learn_profiles(train: DataFrame, size: int = 400) -> list[tuple[str, int, int]]:
    """(lang, gram, rank from 0) of each language's ``size`` most frequent n-grams in all of ``train``.

    ``train`` has text and lang; rows with a null in either teach nothing.  Ties go to the smaller
    key.  The result holds ``size`` rows for each language at most.
    """
    rows = train.where("text is not null and lang is not null").select("lang", "text").mapInArrow(tidy(_count), "lang string, gram long, n long")
    counts = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return [(r.lang, r.gram, r.r - 1) for r in counts.select("lang", "gram", rank.alias("r")).where(F.col("r") <= size).collect()]


class Profiles:
    """Languages' ranks as one matrix; ``nearest`` gives the language at the least out-of-place distance."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.uint64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        at = {g: i for i, g in enumerate(self.grams.tolist())}
        for lang, gram, rank in rows:
            self.ranks[at[gram], self.langs.index(lang)] = rank

    def nearest(self, text: str | None) -> tuple[str, float]:
        keys, counts = np.unique(ngrams(text or ""), return_counts=True)
        if not len(keys) or not (keys >> np.uint64(3 * _BITS) == 1).any() or not self.langs:
            return "und", 0.0
        keys = keys[np.lexsort((keys, -counts))[: self.size]]
        at = np.searchsorted(self.grams, keys)
        at = np.where(np.append(self.grams, np.uint64(0))[at] == keys, at, len(self.grams))
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(keys))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], float(1 - apart[best] / (self.size * len(keys)))


def identify_language(docs: DataFrame, profiles: list[tuple[str, int, int]], keep: list[str], size: int = 400) -> DataFrame:
    """The ``keep`` columns with lang_pred and score; the prediction sees nothing but the whole text.

    lang_pred is the language whose profile is nearest to the document's own ranking of its ``size``
    most frequent n-grams; ties go to the first in alphabetical order.  score is 1 at distance none
    and 0 at the largest possible.  A null text, one without a letter, or no profiles give ``und``
    with score 0.  Repeated rows are scored alike; no rows give no rows.
    """
    spec = docs.sparkSession.sparkContext.broadcast(profiles)  # size rows for each language at most
    passed = keep if "text" in keep else [*keep, "text"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(spec.value, size)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [model.nearest(t.as_py()) for t in batch["text"]]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*keep, "lang_pred", "score"])

    fields = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double"])
    return docs.select(*passed).mapInArrow(tidy(predict), fields)


def language_of_documents(docs: DataFrame, size: int = 400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from rows whose crc32(doc_id as text) mod 4 is not 2."""
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4) == 2
    docs = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    return identify_language(docs, learn_profiles(docs.where(~F.col("held_out")), size), ["doc_id", "held_out"], size)
