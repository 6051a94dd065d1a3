"""Results of the learned and chained operators held against what they must add up to, and the files against what is read."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm.class_lm import class_lm_scores
from loomspan.llm.embedding_dedup import near_vectors
from loomspan.llm.token_files import files_of, tokens_at, write_token_files

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_single_tokens_open_only_their_files(spark, tmp_path):
    out, path = f"file://{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i * 3, f"text number {i} of many") for i in range(400)] + [(600, f"twin {i}") for i in range(60)] + [(None, "no id")], "doc_id long, text string").repartition(4)
    write_token_files(docs, path, out, rows_per_file=40)
    asked = files_of(spark, out, [300, 9])
    plan = asked._jdf.queryExecution().executedPlan().toString()
    buckets = [int(p.name.split("=")[1]) for p in (tmp_path / "ids" / "ids").glob("bucket=*")]
    scanned = asked.select(F.input_file_name().alias("f")).distinct().count()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(doc_id" in plan
    assert scanned == 2 < len(buckets)
    wanted = spark.createDataFrame([(300, 0), (9, 1), (600, 0), (7, 0), (None, 0), (1197, 99)], "doc_id long, place long")
    few, many = (sorted(map(tuple, tokens_at(spark, out, wanted, most=n).collect()), key=str) for n in (10_000, 2))
    assert few == many and len(few) == 5 + 61 and {x[2] for x in few if x[0] in (7, None, 1197)} == {None}


def test_probabilities_behind_any_word_add_up_to_one(spark):
    """Without a look at the model: what pairs of words score, against what one word scores.

    Of P(v | w), P(w | start) and P(end | w) only products are seen.  With a = P(. | start), the ratio of the score of "w v" and that of
    "v" is a_w P(v | w) / a_v, so sums to 1 behind every w give a linear system for a; its solution must add up to 1, too.
    """
    rng = random.Random(7)
    words = [f"w{i}" for i in range(6)]
    train = [(i, " ".join(rng.choice(words[: 3 + i % 4]) for _ in range(rng.randrange(0, 9)))) for i in range(150)]
    every = [*words, "never"]
    asked = ["", *every, *(f"{a} {b}" for a in every for b in every)]
    df = spark.createDataFrame([*train, *((1000 + i, t) for i, t in enumerate(asked))], "doc_id long, text string")
    found = {r.doc_id: 10**r.score for r in class_lm_scores(df, F.col("doc_id") >= 1000, classes=5, share=1e-4).where("held_out").collect()}
    p = {t: found[1000 + i] for i, t in enumerate(asked)}
    n = len(every)
    ratio = np.array([[p[f"{w} {v}"] / p[v] for v in every] for w in every])
    start = np.linalg.solve(np.eye(n) - ratio, np.array([p[w] for w in every]))
    assert (start > 0).all() and start.sum() + p[""] == pytest.approx(1, abs=1e-6)


def test_recall_of_many_planted_pairs(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9005, 0.96, (len(x), 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * side
    rows = [(2 * i, x[i].tolist()) for i in range(len(x))] + [(2 * i + 1, y[i].tolist()) for i in range(len(x))]
    found = {r.vec_id: r.component_id for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()}
    assert sum(found[2 * i] == found[2 * i + 1] for i in range(len(x))) >= 0.98 * len(x)


# pipeline


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("gid", F.lit("clash")).withColumn("kept", F.lit(1))


def _texts():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, whole = text(120), text(200)
    rows = [(i, text(rng.randrange(30, 90))) for i in range(12)]
    rows += [(20, f"{text(60)} {passage} {text(40)}"), (21, f"{text(50)} {passage}"), (None, f"{passage} {text(70)}"), (30, whole), (31, whole + " tail"), (31, text(50)), (32, None), (33, ""), (None, None)]
    return rows


def _stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_one_of_near_copies_stays(spark, sf_dir):
    rows = _texts()
    kept = _stage("n-gram Jaccard join")(spark, _docs(spark, rows), sf_dir)
    assert kept.columns == corpus_pipeline.COLUMNS
    # 30 and 31 are near copies; rows of one doc_id are one document
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, ((i, t) for i, t in rows if i != 31)))


def test_repeated_bytes_go_row_by_row(spark, sf_dir):
    rows = _texts()
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[p : p + 400] for x in data for p in range(len(x) - 399))
    want = []
    for (i, _), x in zip(rows, data, strict=True):
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 399):
            if seen[x[p : p + 400]] > 1:
                gone[p : p + 400] = True
        rest = bytes(np.frombuffer(x, np.uint8)[~gone]).decode()
        want.append((str(i), rest, "en", "s", len(rest)))
    out = _stage("suffix-array dedup")(spark, _docs(spark, rows), sf_dir)
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted((str(r.doc_id), r.text, r.lang, r.source, r.n_chars) for r in out.collect()) == sorted(want)


def test_packed_pieces_are_the_documents(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [*_texts(), (50, "long text " * 5000), (51, "long text " * 5000), (51, "long text " * 5000)]
    out = _stage("best-fit packing")(spark, _docs(spark, rows), sf_dir).collect()
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((str(i), k, 4096 * k, len(ids[4096 * k : 4096 * k + 4096])) for k in range(-(-len(ids) // 4096)))
    assert Counter((str(r.doc_id), r.piece, r.start, r.length) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places[:-1])]).tolist() and sum(n for _, n in places) <= 4096
    assert len(by) == -(-sum(r.length for r in out) // 4096)


def test_rejected_documents_go_and_others_stay_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, "12 34", "en", None, 5), (None, None, None, None, 0), (10**9, "", "en", "s", 0)], docs.schema)
    before = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.unionByName(odd).select("doc_id", "text").collect()}
    first = _stage("language ID")(spark, docs.unionByName(odd), sf_dir)
    after = [(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in first.collect()]
    assert set(after) <= before and len(after) == len(set(after)) >= 0.9 * docs.count() and all(i is not None and i < 10**9 for i, _ in after)
