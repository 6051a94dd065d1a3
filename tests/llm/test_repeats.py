import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.llm.suffix_array import rank_suffixes, suffix_ranks
from loomspan.llm.suffix_dedup import remove_repeats
from loomspan.llm.workspace import Workspace


def brute(rows):
    seen = {}
    data = {i: (t or "").encode() for i, t in rows}
    for x in data.values():
        for p in range(len(x) - 399):
            k = x[p : p + 400]
            seen[k] = seen.get(k, 0) + 1
    out = {}
    for i, x in data.items():
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 399):
            if seen[x[p : p + 400]] > 1:
                gone[p : p + 400] = True
        runs = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out[i] = (len(x), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest())
    return out


def corpus():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage, long = text(399), text(1500)
    rows = [(0, None), (1, ""), (2, "x" * 900), (3, "ab" * 450), (4, "x" * 500 + text(200)), (5, text(300)), (6, long), (7, long), (8, text(5000))]
    for i in range(9, 40):
        cut = rng.randrange(0, 900)
        shared = long[cut : cut + rng.randrange(380, 600)] if i % 2 else passage + rng.choice("pq")
        rows.append((i, text(rng.randrange(0, 300)) + shared + text(rng.randrange(0, 300))))
    edited = list(long)
    for p in range(100, 1500, 420):
        edited[p] = "Z"
    return [*rows, (40, "".join(edited)), (41, rows[8][1][:2000] + rows[8][1][1000:1900])]


@pytest.mark.parametrize("base", [100, 100_000])
def test_against_all_windows(spark, base):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("h1", F.lit("x"))
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, base=base).collect()}
    assert found == brute(rows)


def test_groups_met_in_spark(spark):
    from loomspan.llm import suffix_dedup as S

    rows = corpus()
    ws = Workspace(spark, "t")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = lambda n: {(r.h1, r.h2): bytes(r.spans) for r in S.repeated_spans(df, ws if n else Workspace(spark, "u"), large=n)[1].collect()}
    assert spans(1) == spans(0)


def test_kept_text_and_no_rows(spark):
    rows = [(1, "a" + "ž" * 300), (2, "b" + "ž" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.kept_text for r in remove_repeats(df, with_text=True).collect()} == {"a", "b"}
    assert remove_repeats(df.where("doc_id < 0")).collect() == []


def test_ranks(spark):
    rng = np.random.default_rng(1)
    blocks = []
    for b in range(4):
        t = [*rng.integers(0, 3, int(rng.integers(20, 50))).tolist()] if b else [1] * 40
        t += [1000 + 10 * b + i for i in range(3 - len(t) % 3)]
        blocks.append((b, np.array(t, np.int64)))
    df = spark.createDataFrame([(b, bytearray(t.tobytes()), bytearray(np.ones(len(t), np.int32).tobytes())) for b, t in blocks], "block long, names binary, sizes binary")
    found = {r.block: np.frombuffer(r.ranks, np.int64) for r in suffix_ranks(df, Workspace(spark, "ranks"), base=10).collect()}
    whole = np.concatenate([t for _, t in blocks])
    order = sorted(range(len(whole)), key=lambda i: whole[i:].tolist())
    want = np.empty(len(whole), int)
    want[order] = np.arange(len(whole))
    assert (np.concatenate([found[b] for b in range(4)]) == want).all() and (rank_suffixes(whole) == want).all()


def phrases(text):
    from loomspan.llm import suffix_dedup as S
    from loomspan.llm import textkit

    (docs,) = textkit.slices(pa.array([text]))
    at = S.cuts(docs, docs.prefix()).tolist()
    data = text.encode()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def most_in_common(texts):
    """For each text the longest run of phrases, in bytes, that starts at one other place, too."""
    from loomspan.llm.suffix_dedup import RUN

    runs = [phrases(t) for t in texts]
    out = [0] * len(texts)
    for i, x in enumerate(runs):
        for j, y in enumerate(runs):
            for p in range(len(x)):
                for q in range(len(y)):
                    n = 0
                    if (i, p) != (j, q):
                        for a, b in zip(x[p:], y[q:], strict=False):
                            if a != b:
                                break
                            n += len(a)
                    out[i] = max(out[i], n if n >= RUN else 0)
    return out


@pytest.mark.parametrize("base", [10, 100_000])
def test_longest_shared_is_the_greatest_common_prefix(spark, base):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    source = text(4000)
    texts = [source]
    for n in (60, 150, 200, 260, 320, 380, 399) * 2:  # two passages each, from different places; other texts overlap them
        a, b = rng.randrange(0, 3500), rng.randrange(0, 3500)
        texts.append(text(rng.randrange(50, 300)) + source[a : a + n] + text(100) + source[b : b + n // 2] + text(80))
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), base=base).collect()}
    want = most_in_common(texts)
    whole = [i for i in found if not found[i].n_removed]
    assert len(whole) > 10 and sum(want[i] > 0 for i in whole) > 5
    assert [found[i].longest_shared for i in whole] == [want[i] for i in whole]


def test_order_decides(spark, monkeypatch):
    from loomspan.llm import suffix_dedup as S

    def shuffled(blocks, ws, base, enough):
        def run(batches):
            for batch in batches:
                mixed = [np.random.default_rng(3).permutation(np.frombuffer(x, np.int64)).tobytes() for x in batch["ranks"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["block"], pa.array(mixed, pa.binary())], ["block", "ranks"])

        return suffix_ranks(blocks, ws, base=base, enough=enough).mapInArrow(run, "block long, ranks binary")

    rows = corpus()
    monkeypatch.setattr(S, "suffix_ranks", shuffled)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got != brute(rows)


def test_prefixes_of_heads():
    from loomspan.llm import suffix_dedup as S

    names, sizes = np.array([5, 5, 5, 7, 99, 5, 5, 7, 98]), np.array([30, 30, 30, 40, 400, 30, 30, 40, 400])
    heads = S._heads(names, sizes, np.array([0, 1, 5, 2, 6, 3]))
    assert S.shared_prefixes(heads).tolist() == [60, 100, 30, 70, 0]
    assert S.shared_prefixes(heads[1:4]).tolist() == [100, 30] and S.shared_prefixes(heads[:1]).tolist() == []
