"""Encoding and decoding of whole texts, with very long ones encoded in parallel and joined exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, join_tree
from .workspace import tidy

#: Texts of more characters are cut into leaves of this many, each encoded in a task of its own.
LEAF_CHARS = 65_536


def encode_texts(docs: DataFrame, path: str, keep: list[str], leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``keep`` columns and ids (binary, little-endian 32-bit) of every whole text.

    Texts of up to ``leaf_chars`` characters are encoded where they are.  Longer ones are cut into
    leaves which are dealt out and encoded in parallel; each document's leaves are then joined pair by
    pair in a tree, where windows around each join are encoded again until both sides agree.

    A null text is an empty one: no ids.  Repeated rows are encoded alike, no rows give no rows.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    docs = docs.select(*keep, F.col("text").alias("__text"))
    long = F.length("__text") > leaf_chars

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = pa.array(enc.encode_column(batch["__text"]), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*keep, "ids"])

    short = docs.where(F.coalesce(~long, F.lit(True))).mapInArrow(tidy(here), f"{fields}, ids binary")
    leaves = docs.where(long).withColumn("__uid", F.monotonically_increasing_id())
    leaves = leaves.select(*keep, "__uid", F.expr(f"posexplode(transform(sequence(0, (length(__text) - 1) div {leaf_chars}), i -> substr(__text, i * {leaf_chars} + 1, {leaf_chars})))").alias("__leaf", "__text"))
    inner = [*keep, "__uid", "__leaf"]

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = pa.array(enc.encode_column(batch["__text"]), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*inner, "ids"])

    encoded = leaves.repartition("__uid", "__leaf").mapInArrow(tidy(leaf), f"{fields}, __uid long, __leaf int, ids binary")

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__leaf")
        ids = join_tree([np.frombuffer(x, np.uint32).tolist() for x in group["ids"]], encoder(path))
        return group[keep].iloc[:1].assign(ids=[np.array(ids, np.uint32).tobytes()])

    return short.unionByName(encoded.groupBy("__uid").applyInPandas(joined, f"{fields}, ids binary"))


def encode_decode_digests(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text's ids and their decoding."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        names = [str(i) for i in range(len(enc.bytes_of))]
        for batch in batches:
            n, a, b = [], [], []
            for raw in batch["ids"].to_pylist():
                ids = np.frombuffer(raw, np.uint32)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(names.__getitem__, ids.tolist())).encode()).hexdigest())
                b.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return encode_texts(docs, path, ["doc_id"], leaf_chars).mapInArrow(tidy(digest), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
