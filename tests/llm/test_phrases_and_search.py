"""Operators 11 to 13 against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomspan.llm import lexical_search as L
from loomspan.llm import phrase_automata
from loomspan.llm.phrase_automata import WORDS, Automaton, anchors, remove_earlier_phrases
from loomspan.llm.radix_select import top_k
from loomspan.llm.source_audit import source_divergence
from loomspan.llm.textkit import slices
from loomspan.llm.workspace import Workspace

# ---- phrases


def plain_removal(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - WORDS + 1):
                k = tuple(w[p : p + WORDS])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - WORDS + 1):
            if i is not None and first[tuple(w[p : p + WORDS])] < i:
                gone.update(range(p, p + WORDS))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def phrase_rows():
    rng = random.Random(11)
    text = lambda n, k=4000: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    passage, long = text(30), text(300)
    rows = [(0, None), (1, ""), (2, "a " * 40), (3, "a\t" * 13 + "b"), (4, "a " * 12), (5, long), (6, long), (6, long + " end"), (7, passage.replace(" ", "\n", 5)), (7, passage)]
    rows += [(8, " ".join(["x"] * 20) + " " + passage), (None, long), (None, passage), (-3, text(40) + " " + passage[: len(passage) // 2])]
    for i in range(9, 70):
        at = rng.randrange(0, 250)
        shared = " ".join(long.split()[at : at + rng.randrange(10, 40)]) if i % 2 else passage
        rows.append((i, text(rng.randrange(0, 30)) + "  " + shared + "\x0b" + text(rng.randrange(0, 30), 9)))
    return rows


@pytest.mark.parametrize("shard", [3, 20_000])
def test_earlier_phrases(spark, shard):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("h1", F.lit("x")).withColumn("spans", F.lit(2.0))
    found = remove_earlier_phrases(df, shard=shard)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_removal(rows)


def test_phrases_without_rows_and_with_text(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(20)))), (2, "x " + " ".join(map(str, range(20))) + " y")], "doc_id int, text string")
    assert {r.doc_id: r.kept_text for r in remove_earlier_phrases(df, with_text=True).collect()}[2] == "x y"
    assert remove_earlier_phrases(df.where("doc_id < 0")).collect() == []


def test_equal_windows_have_equal_anchors():
    import pyarrow as pa

    rng = random.Random(3)
    body = [rng.choice("abc") for _ in range(60)]
    docs = [" ".join(body), "z z " + " ".join(body[5:40]) + " q", " ".join(body[7:20])]
    (d,) = slices(pa.array(docs))
    by = defaultdict(set)
    for who, h, at, size, _ in zip(*anchors(d), strict=True):
        w = docs[who].split()
        for p in range(at, at + size - WORDS + 1):
            by[tuple(w[p : p + WORDS])].add(int(h))
    assert all(len(x) == 1 for x in by.values())
    assert len(by) == len({tuple(w[p : p + WORDS]) for w in map(str.split, docs) for p in range(len(w) - WORDS + 1)})


def test_automaton_takes_words_as_letters():
    phrase = " ".join(f"v{i}" for i in range(WORDS))
    a = Automaton([phrase, " ".join(["a"] * WORDS)], [7, 8])
    places = lambda text: list(a.places(text.split(" ")))
    assert places("v " + phrase + " v0") == [(1, 7)]
    assert places(" ".join(["a"] * (WORDS + 1))) == [(0, 8), (1, 8)]
    assert places(phrase.replace("v1 ", "v1v ")) == [] and list(Automaton([], []).places(["a", "b"])) == []


# ---- audit


def plain_audit(rows, least):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(la or "", so or "", term.findall((t or "").translate(lower))) for t, la, so in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for la, so, ts in docs:
        df[la].update(set(ts))
        count[la, so].update(ts)
    out = []
    for la in {d[0] for d in docs}:
        kept = [t for t, n in df[la].items() if n >= least]
        v = len(kept)
        sources = sorted({d[1] for d in docs if d[0] == la})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        whole = share(sum((count[la, s] for s in sources), Counter()))
        shares = {s: share(count[la, s]) for s in sources}
        for s in sources:
            pairs = sorted(((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            marks = sorted((-f(shares[s][t], whole[t]), t.encode()) for t in kept if count[la, s][t] and shares[s][t] > whole[t])
            for part, found in (("pair", pairs), ("term", marks[:10])):
                out += [(la, s, part, o.decode(), -x, n + 1) for n, (x, o) in enumerate(found)]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(12)
    vocabulary = [f"{c}{x}" for c in ("Ä", "a", "zz", "ž", "𝔸") for x in "abcdefgh"]
    rows = []
    for i in range(300):
        pick = rng.sample(vocabulary, 12)
        rows.append((" ".join(rng.choice(pick).upper() if rng.random() < 0.2 else rng.choice(pick) for _ in range(rng.randrange(0, 60))) + "1x_y", rng.choice(["en", "de", "en"]), rng.choice(["s1", "s2", "s3", None, ""])))
    rows += [(None, None, None), ("", "fr", "s1"), ("alone here", "fr", "s2"), ("wort", None, "x"), *[("same same " * 3, "it", f"s{i % 2}") for i in range(30)]]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("value", F.lit("v"))
    found = source_divergence(df)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, 10)
    assert source_divergence(df.limit(0)).collect() == []


@pytest.mark.parametrize("k", [1, 5, 40])
def test_radix_select(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 3, 3, 70_000, 1 << 40, rng.randrange(1 << 50)]), rng.choice("žzaä") * rng.randrange(1, 30)) for _ in range(600)]
    rows += [("big", 9, f"same prefix of many items {i:04d}") for i in range(200)] + [("twins", 5, "x")] * 60
    df = spark.createDataFrame(rows, "g string, v long, item string")
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))
        want += [(*r, n + 1) for n, r in enumerate(own[:k])]
    assert sorted(map(tuple, top_k(df, ["g"], "v", "item", k, Workspace(spark, "t")).collect()), key=str) == sorted(want, key=str)
    assert top_k(df.limit(0), ["g"], "v", "item", k, Workspace(spark, "t")).collect() == []


# ---- search


def plain_search(docs, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tfs = [(i, Counter(term.findall((t or "").translate(lower)))) for i, t in docs]
    n = sum(1 for _, c in tfs if c)
    total = sum(c.total() for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for key, text in items:
        asked, found = term.findall((text or "").translate(lower)), []
        for i, c in tfs:
            if c:
                m = 100 - 75 + (75 * c.total() * n) // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
                if s > 0:
                    found.append((-s, i is None, i or 0, i))
        out += [(key, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 30_000])
def test_search(spark, tmp_path, block):
    rng = random.Random(13)
    words = [f"t{i}" for i in range(300)] + ["Über", "naïve", "42"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 50))) + rng.choice(["", "!", "-T1 ", "_"])) for i in range(200)]
    docs += [(500, None), (501, ""), (None, docs[7][1]), (7, docs[7][1]), (502, " ".join(["t5"] * 5000)), (503, "every " * 3)]
    docs += [(600 + i, "every common") for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(12)] + [(12, None), (13, ""), (14, "nowhere"), (15, "every every COMMON"), (15, "every every COMMON"), (None, "t5 t5")]
    L.write_index(spark.createDataFrame(docs, "doc_id long, text string").withColumn("terms", F.lit(1)).repartition(3), str(tmp_path / "index"), block_docs=block)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = L.search(spark, str(tmp_path / "index"), asked, batch=7)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(docs, items)
    assert L.search(spark, str(tmp_path / "index"), asked.limit(0)).collect() == []


def test_search_without_documents(spark, tmp_path):
    L.write_index(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "index"))
    assert L.search(spark, str(tmp_path / "index"), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_blocks_are_read_one_by_one(spark, tmp_path):
    """Each block of the index is a row group of its own, so a task holds one of its blocks at a time."""
    docs = spark.createDataFrame([(i, f"word{i} every") for i in range(50)], "doc_id long, text string").coalesce(1)
    L.write_index(docs, str(tmp_path / "index"), block_docs=5)
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "index" / "blocks").glob("*.parquet")]
    assert sum(f.num_rows for f in files) == 10
    assert {f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)} == {1}


def test_bounds_hold_the_impact():
    tf, n = np.arange(1, 2000), np.arange(1, 2000) * 7 % 5000 + 1
    exact = L.impacts(tf, n, 1000, 300_000)
    level = -(-exact // L.STEP)
    assert level.max() <= 255 and (level * L.STEP >= exact).all() and (level * L.STEP - (L.STEP - 1) * (level > 0) <= exact).all()
    assert (L.impacts(tf, n, 1 << 50, 1 << 55) == [10**9 * t // (1000 * t + 8 * (25 + 75 * m * 2**50 // 2**55)) for t, m in zip(tf.tolist(), n.tolist(), strict=True)]).all()


def test_stretches_carry_the_shards_of_their_anchor(spark):
    """A frequent anchor's stretches are told from others by a column of theirs, so no join repeats them."""
    words = " ".join(f"w{i}" for i in range(13))
    rows = [(1, 1, k, 0, words, 3) for k in range(5)] + [(2, 2, k, 0, words.replace("w", "v"), 1) for k in range(5)]
    stretches = spark.createDataFrame([(a, b, k, k, at, w, n) for a, b, k, at, w, n in rows], "hash long, h1 long, h2 long, doc long, at int, words string, parts int")
    found = phrase_automata._occurrences(stretches, 2)
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.h1, r.h2, r.a, r.b) for r in found.collect()) == [(h, k, 0, 13) for h in (1, 2) for k in range(1, 5)]
