import random

import numpy as np
import pytest

import corpus_pipeline
from loomspan.llm.suffix_dedup import remove_repeats


def brute(rows, span):
    """For each row: removed bytes, removed runs, the rest."""
    seen, data = {}, {i: t.encode() for i, t in rows}
    for x in data.values():
        for p in range(len(x) - span + 1):
            seen[x[p : p + span]] = seen.get(x[p : p + span], 0) + 1
    out = {}
    for i, x in data.items():
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - span + 1):
            if seen[x[p : p + span]] > 1:
                gone[p : p + span] = True
        runs = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out[i] = (int(gone.sum()), runs, bytes(np.frombuffer(x, np.uint8)[~gone]).decode("utf-8", "ignore"))
    return out


def corpus(span):
    """Shared stretches from just below to just above ``span`` bytes, copies, periods, and repeats inside one text."""
    rng = random.Random(span)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    source = text(2000)
    rows = [(0, ""), (1, "x" * 900), (2, "ab" * 450), (3, "x" * (span + 9) + text(90)), (4, source), (5, source), (6, source[:700] + source[100:800])]
    for i in range(7, 60):
        a = rng.randrange(0, 1400)
        rows.append((i, text(rng.randrange(0, 200)) + source[a : a + rng.randrange(span * 8 // 10, span * 12 // 10)] + text(rng.randrange(0, 200))))
    return rows


@pytest.mark.parametrize(("span", "base"), [(112, 100_000), (113, 100), (250, 100), (250, 100_000), (591, 100_000)])
def test_any_span_against_all_windows(spark, span, base):
    rows = corpus(span)
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), base=base, with_text=True, span=span).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans, r.kept_text) for r in found} == brute(rows, span)


@pytest.mark.parametrize("span", [111, 592])
def test_spans_out_of_reach_are_refused(spark, span):
    with pytest.raises(ValueError, match="112 to 591"):
        remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), span=span)


def test_pipeline_removes_passages_of_51_words(spark, sf_dir):
    """51 words of four letters or more are often under 400 bytes; what is around them stays, and so do passages of 40 short words."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 8))) for _ in range(4000)]
    four = [w for w in words if len(w) == 4]
    text = lambda n, of=words: " ".join(rng.choice(of) for _ in range(n))
    rows, want = [], []
    for k in range(30):
        passage = (text(51), text(51, four), text(40, four))[k % 3]
        assert len(passage) < 400
        for edge in "XY":  # so that no more than the passage is shared
            before, behind = f"{text(rng.randrange(5, 60))} {edge}", f"{edge} {text(rng.randrange(5, 60))}"
            rows.append((len(rows), before + passage + behind))
            want.append(before + behind if k % 3 < 2 else rows[-1][1])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["suffix-array dedup"](spark, docs, sf_dir).collect()}
    assert [out[i].text for i, _ in rows] == want and all(r.n_chars == len(r.text) for r in out.values())
