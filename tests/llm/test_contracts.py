"""Learned operators against plain versions, and edge cases of all."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import quality
from loomspan.llm.class_lm import Core, class_lm_scores, class_of_each, class_tables
from loomspan.llm.embedding_dedup import near_vectors
from loomspan.llm.language import identify_language, learn_profiles
from loomspan.llm.ngram_join import ngram_jaccard_components
from loomspan.llm.packing import pack_documents, plan_packing
from loomspan.llm.quality import quality_verdicts
from loomspan.llm.sharding import balanced_shards
from loomspan.llm.suffix_dedup import remove_repeats
from loomspan.llm.token_files import open_token_files, read_token_files, tokens_at, write_token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# language ID against a plain version of rank order and out-of-place distance


def _plain_grams(text: str) -> Counter:
    out, chars = Counter(), []
    for c in f" {text} ":
        low = c.lower() if len(c.lower()) == 1 else c
        c = low if c.isalpha() else " "
        if c != " " or not chars or chars[-1] != " ":
            chars.append(c)
    s = "".join(chars)
    for n in (1, 2, 3):
        out.update(s[i : i + n] for i in range(len(s) - n + 1) if s[i : i + n] != " ")
    return out


def _ranked(grams: Counter, size: int) -> list[str]:
    key = lambda g: sum((0 if c == " " else ord(c)) << 18 * (len(g) - 1 - i) for i, c in enumerate(g)) | len(g) << 54
    return sorted(grams, key=lambda g: (-grams[g], key(g)))[:size]


def test_language_equals_out_of_place_distance(spark):
    rows = [(1, "der hund und die katze und das haus", "de"), (2, "the dog and the cat and the house", "en"), (3, "le chien et le chat et la maison", "fr"),
            (4, "und der und die haus", None), (5, "the the and and", None), (6, "maison le chat", None), (7, "", None), (8, None, None), (9, "12 !?", None), (10, "the the and and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(docs, learn_profiles(docs, 60), ["doc_id"], 60).collect()}
    profiles = {lang: {g: i for i, g in enumerate(_ranked(_plain_grams(t), 60))} for _, t, lang in rows if lang}
    for key, text, _ in rows:
        own = _ranked(_plain_grams(text or ""), 60)
        if not any(g.strip() for g in own):
            assert got[key] == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else 60 for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[key][0] == best
        assert got[key][1] == pytest.approx(1 - far[best] / (60 * len(own)))
    assert got[5] == got[10]


# quality rules: the distance against numpy


def test_quality_distance_equals_numpy(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        words = ["w" * int(rng.integers(3, 9)) + str(int(rng.integers(0, 10**6))) for _ in range(int(rng.integers(20, 90)))]
        if i % 40 == 0:
            words = [w + "#$%" * int(rng.integers(1, 4)) for w in words]
        rows.append((i, " ".join(words), "en", "a" if i % 2 else "b", 0))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in quality_verdicts(docs).collect()}
    stats = {k: quality.transformed(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for k, r in got.items()}
    for source in "ab":
        keys = [i for i, _, _, s, _ in rows if s == source]
        x = np.array([stats[k] for k in keys])
        expected = quality_reference(x)
        for k, d in zip(keys, expected, strict=True):
            assert got[k].distance == pytest.approx(d, rel=0.02, abs=0.05)
            assert got[k].kept == (got[k].distance <= quality.CUTOFF)


def quality_reference(x: np.ndarray) -> np.ndarray:
    """The same estimate by exact order statistics on one machine."""
    h, floors = quality.SHARE, np.array(quality.FLOORS)

    def moments(y):
        return y.mean(axis=0), np.cov(y.T, bias=True) + np.diag(floors**2)

    def far(y, m, c):
        z = y - m
        return np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z)

    edge = lambda d: d <= np.sort(d)[max(0, math.ceil(h * len(d)) - 1)]
    best = None
    for start in quality.STARTS:
        d = start_distance(start, x, floors)
        for _ in range(quality.STEPS):
            m, c = moments(x[edge(d)])
            d = far(x, m, c)
        m, c = moments(x[edge(d)])
        det = np.linalg.det(c)
        if best is None or det < best[0] * (1 - 1e-12):
            best = det, far(x, m, c)
    return best[1] * quality.consistency(len(floors), h)


def start_distance(start: str, x: np.ndarray, floors: np.ndarray) -> np.ndarray:
    mid = np.array([np.sort(c)[max(0, math.ceil(0.5 * len(c)) - 1)] for c in x.T])
    if start == "medians":
        return (((x - mid) / floors) ** 2).sum(axis=1)
    if start == "means":
        return (((x - x.mean(axis=0)) / np.sqrt(x.var(axis=0) + floors**2)) ** 2).sum(axis=1)
    spread = np.array([np.sort(np.abs(x[:, i] - mid[i]))[max(0, math.ceil(0.5 * len(x)) - 1)] for i in range(x.shape[1])])
    return (np.abs(x - mid) / (1.4826 * spread + floors)).max(axis=1)


def test_quality_ties_nulls_and_copies(spark):
    same = " ".join(f"word{i}" for i in range(30))
    rows = [(1, same, "en", "a", 0), (1, same, "en", "a", 0), (2, same, None, None, 0), (None, same, "en", "a", 0), (3, None, "en", "a", 0), (4, "", None, "a", 0), (5, "few words", "en", "a", 0)]
    out = [(r.doc_id, r.base_failed, r.kept) for r in quality_verdicts(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(out, key=str) == sorted([(1, False, True), (1, False, True), (2, False, True), (None, False, True), (3, True, False), (4, True, False), (5, True, False)], key=str)
    assert quality_verdicts(spark.createDataFrame([], DOCS)).count() == 0


# class LM: probabilities sum to one, scores follow from the tables


def test_class_lm_probabilities_and_scores(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocab, 30))) for i in range(60)] + [(100, "w1 W1 unknown w2"), (101, ""), (102, None), (103, "w1 W1 unknown w2"), (None, "w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.coalesce(F.col("doc_id") >= 100, F.lit(True)))
    got = {r.doc_id: r for r in class_lm_scores(docs.select("doc_id", "text", "held"), F.col("held"), classes=6, share=1 / 50, sweeps=3).collect()}
    tokens = Counter(t for i, text in rows if i is not None and i < 100 for t in [*text.lower().split(), "\0"])
    total, distinct = sum(tokens.values()), len(tokens)
    for key, text in rows:
        seq = [*(text or "").lower().split(), "\0"]
        r = got[key]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(seq), sum(tokens[t] > 0 for t in seq), total)
        assert r.base_score == pytest.approx(sum(math.log10((tokens[t] + 1) / (total + distinct + 1)) for t in seq))
        assert r.score < 0
    assert got[100].score == got[103].score
    assert got[101].score == got[102].score


def test_class_tables_are_probabilities(spark):
    rng = np.random.default_rng(2)
    rows = [(7, bytes([*(int(c) | (128 if rng.random() < 0.3 else 0) for c in rng.integers(1, 5, 6)), 0])) for _ in range(50)]
    coded = spark.createDataFrame(rows, "n_tokens long, classes binary")
    log, sizes = class_tables(coded, 6, 1000)
    assert np.allclose((10**log).sum(axis=1), 1.0)
    count = Counter(b & 127 for _, raw in rows for b in raw)
    assert sizes.tolist() == [count[c] for c in range(6)]
    empty, _ = class_tables(coded.limit(0), 6, 1)
    assert np.isfinite(empty[:, -1]).all()


def test_other_words_take_the_likeliest_class():
    log = np.log(np.array([[0.1, 0.6, 0.2, 0.1], [0.3, 0.1, 0.5, 0.1], [0.4, 0.4, 0.1, 0.1], [0.25] * 4]))
    core = Core(np.array([1, 5], np.uint64), np.array([0, 1]), log, np.array([10.0, 20.0, 20.0, 5.0]))
    keys, counts = np.array([5, 7, 9], np.uint64), np.array([20, 1, 1])
    got = class_of_each(keys, counts, core, np.array([1, 2]), np.array([0, 1], np.uint8), np.array([2, 0], np.uint8))
    best = [max((1, 2), key=lambda c, p=p, q=q: log[p, c] + log[c, q] - math.log(core.sizes[c] + 2)) for p, q in ((0, 2), (1, 0))]
    assert got.tolist() == [1, best[0] | 128, best[1] | 128]


def test_class_lm_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").withColumn("held", F.lit(True))
    got = {r.doc_id: r for r in class_lm_scores(docs, F.col("held"), classes=4, sweeps=2).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and math.isfinite(got[1].score)


# token files


@pytest.mark.parametrize("kind", ["long", "string"])
def test_token_files_order_places_and_single_tokens(spark, tmp_path, kind):
    path, out = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/ids"
    rows = [(i * 7 % 50, f"text number {i} " * (i % 5)) for i in range(50)] + [(None, "without id"), (3, None), (3, "text number 3 again"), (3, "text number 3 again")]
    docs = spark.createDataFrame([(None if i is None else (f"{i:03}" if kind == "string" else i), t) for i, t in rows], f"doc_id {kind}, text string")
    write_token_files(docs, path, out, rows_per_file=10)
    files = open_token_files(spark, out).collect()
    ends = defaultdict(list)
    for r in files:
        ends[r.bucket].append(r.doc_id)
    seen = [(min((x for x in v if x is not None), default=None), max((x for x in v if x is not None), default=None)) for _, v in sorted(ends.items())]
    seen = [s for s in seen if s[0] is not None]
    assert len(seen) > 2 and all(a[1] <= b[0] for a, b in zip(seen, seen[1:], strict=False))
    got = sorted(read_token_files(spark, out).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert got[0].doc_id is None and len(got) == len(rows)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    key = docs.where("doc_id is not null").first().doc_id
    text = docs.where(F.col("doc_id") == key).first().text
    ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
    wanted = spark.createDataFrame([(key, i) for i in range(len(ids) + 1)] + [(key, -1)], f"doc_id {kind}, place long")
    assert {r.place: r.id for r in tokens_at(spark, out, wanted).collect()} == dict(enumerate(ids)) | {len(ids): None, -1: None}


def test_token_files_of_no_rows(spark, tmp_path):
    write_token_files(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/none")
    assert read_token_files(spark, f"file://{tmp_path}/none").collect() == []


def test_token_files_spread_one_id(spark, tmp_path):
    docs = spark.createDataFrame([(5, f"row {i}") for i in range(60)], "doc_id long, text string")
    write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/one", rows_per_file=10)
    assert len({r.bucket for r in open_token_files(spark, f"file://{tmp_path}/one").collect()}) > 2
    got = sorted(read_token_files(spark, f"file://{tmp_path}/one").collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()


# packing


def test_packing_uses_triples_and_keeps_rows(spark):
    plan = plan_packing({50: 1, 20: 1, 17: 1, 13: 1}, 100)
    assert plan == [((50, 20, 17, 13), 1)]
    rows = [(1, "same text"), (1, "same text"), (None, "same text"), (None, None), (2, "")]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((str(r.doc_id), r.length) for r in out) == sorted([("1", 3), ("1", 3), ("None", 3), ("None", 1), ("2", 1)])
    assert len({(r.sequence_id, r.offset) for r in out}) == 5


# other operators: nulls, repeats, clashing names


def test_join_of_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (3, b + " more"), (9, a + " more"), (7, "alone in the world of words"), (7, "alone in the world of words"), (None, a)]
    out = ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    assert {r.component_id for r in out if r.doc_id in (3, 5, 9)} == {3}
    assert {r.component_id for r in out if r.doc_id == 7} == {7}


def test_join_cuts_heavy_clusters(spark):
    base = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(40)] + [(100 + i, " ".join(f"x{i}_{k}" for k in range(30))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r.doc_id, r.component_id) for r in ngram_jaccard_components(docs).collect()}
    assert {(r.doc_id, r.component_id) for r in ngram_jaccard_components(docs, unit=8, weight=300).collect()} == whole
    assert whole == {(i, 0) for i in range(40)} | {(100 + i, 100 + i) for i in range(5)}


def test_longest_shared_tells_of_short_passages(spark):
    rng = np.random.default_rng(7)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n))
    passage = text(52)
    rows = [(1, f"{text(200)} {passage} {text(200)}"), (2, f"{text(150)} {passage} {text(100)}"), (3, text(300)), (4, text(60)), (5, None)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.n_removed == 0 for r in got.values())
    assert 100 <= got[1].longest_shared <= len(passage) + 2 and got[1].longest_shared == got[2].longest_shared
    assert got[3].longest_shared == got[4].longest_shared == got[5].longest_shared == 0


def test_shards_of_null_and_repeated_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, None), (2, "c" * 50)]
    out = balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert len(out) == 5
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_vectors_without_id(spark):
    rows = [(1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, None), (None, None)]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(out) == 4
    assert {(r.vec_id, r.component_id) for r in out if r.vec_id is not None} == {(1, 1), (2, 2)}


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", "x", "y")], "doc_id long, text string, g string, n string")
    assert ngram_jaccard_components(docs).columns == ["doc_id", "n_shingles", "component_id"]
    assert remove_repeats(docs).count() == 1
    assert balanced_shards(docs).count() == 1
