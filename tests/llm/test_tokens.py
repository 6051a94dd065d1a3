import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspan.llm.codec import encode_decode_digests
from loomspan.llm.packing import pack_documents, plan_packing
from loomspan.llm.sharding import balanced_shards
from loomspan.llm.token_files import pack, read_token_files, token_at, unpack, write_token_files
from loomspan.llm.workspace import Workspace

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
_rng = random.Random(6)
TEXTS = [
    None, "", " ", "  a  b ", "Hello, world! it's 12 o'clock\n\n  x", "<|endoftext|> and < |", "žluťoučký kůň 😀😀 漢字かな", "àé ﬁ İ", "  x y",
    "x" * 9000, "ab1" * 4000, "é" * 5000, "1234567890" * 900, " " * 5000, "!?" * 5000, "word " * 3000, "a\r\nb\tc", "‘quote’ — dash…", "'s 'll 'S don't",
    "".join(_rng.choice("abcdefghijklmnop") for _ in range(20_000)), "".join(_rng.choice("ab 1é!\n漢") for _ in range(9000)), "Ünïcödé" * 700, "\x00\x01\x7f",
]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    own = spark.createDataFrame(list(enumerate(TEXTS, 10_000)), "doc_id long, text string")
    return own.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumn("ids", F.lit(1)).withColumn("__uid", F.lit(2)).persist()


@pytest.mark.parametrize("leaf", [65_536, 1000])
def test_codec(docs, leaf):
    t = library(BYTES)
    found = {r.doc_id: r for r in encode_decode_digests(docs, BYTES, leaf).collect()}
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        f = found[r.doc_id]
        assert f.n_tokens == len(ids) and f.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (r.doc_id, (r.text or "")[:40])
        assert f.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_files(spark, docs):
    t = library(BYTES)
    out = f"{Workspace(spark, 'files').root}/ids"
    write_token_files(docs, BYTES, out, rows_per_file=60)
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, out).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], np.uint32)
        assert found[r.doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_codes_give_any_token():
    rng = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.integers(0, 1 << 31, n) >> rng.integers(0, 30, n)).astype(np.uint32)
        codes = pack(ids)
        assert (unpack(codes) == ids).all()
        assert all(token_at(codes, int(i)) == ids[i] for i in rng.integers(0, n, 50)) if n else True


def test_packing(docs):
    t = library(WORDS)
    rows = pack_documents(docs, WORDS).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(text)
    total = 0
    for k, own in pieces.items():
        ids = np.array([*t.encode(text[k] or "", add_special_tokens=False).ids, 1], np.uint32)
        own.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(i, a, min(4096, len(ids) - a)) for i, a in enumerate(range(0, len(ids), 4096))], (k, (text[k] or "")[:40])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        total += len(ids)
    for own in sequences.values():
        own.sort()
        assert sum(n for _, n in own) <= 4096 and [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    assert len(sequences) <= -(-total // 4096) + 1


def test_plan_fills_gaps_exactly():
    plan = plan_packing({10: 1, 6: 4, 4: 2, 2: 3, 3: 2, 1: 1}, 10)
    used = {}
    for lengths, times in plan:
        assert sum(lengths) <= 10
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == {10: 1, 6: 4, 4: 2, 2: 3, 3: 2, 1: 1} and sum(t for _, t in plan) == 6
    assert plan_packing({}, 10) == []


def test_shards(spark, docs):
    rows = balanced_shards(docs, rows_per_part=30).collect()
    sizes, by = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        by.setdefault(r.shard, []).append((r.slot, r.doc_id))
    assert len(rows) == docs.count() and max(sizes) == 23
    for own in by.values():
        own.sort()
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)
    assert balanced_shards(docs.where("doc_id < 0")).collect() == []
