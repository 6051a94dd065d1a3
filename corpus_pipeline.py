"""From raw documents to packed training sequences, in five stages over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.language import identify_language, learn_profiles
from loomspan.llm.ngram_join import ngram_jaccard_components
from loomspan.llm.packing import pack_documents
from loomspan.llm.quality import quality_verdicts
from loomspan.llm.suffix_dedup import remove_repeats
from loomspan.llm.workspace import Workspace, removed_after, small_side

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose nearest profile is farther away than this are in none of the known languages.
LEAST_SCORE = 0.25
#: A passage of over 50 words goes where it repeats: fifty words of four letters, each with a space, have so many bytes.
PASSAGE = 250


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages are learned from all labelled rows; rows in none of them go, others get the predicted one.

    A null or empty text, or one without a letter, goes.
    """
    found = identify_language(docs, learn_profiles(docs), COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rules or are outliers of their language and source go.  Ties and copies fare alike."""
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("__h"))
    verdicts = Workspace(spark, "verdicts").save(quality_verdicts(keyed.withColumnRenamed("__h", "h"), ["doc_id", "h"]).where("kept"), "kept")
    good = small_side(verdicts.select(F.col("doc_id").alias("__id"), F.col("h").alias("__k")))
    return keyed.join(good, F.expr("doc_id <=> __id and __h = __k"), "left_semi").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the least doc_id stays; rows without doc_id stay."""
    found = ngram_jaccard_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__id"))
    gone = small_side(Workspace(spark, "duplicates").save(found, "gone"))
    return docs.join(gone, F.expr("doc_id = __id"), "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of PASSAGE bytes that are repeated elsewhere; n_chars follows.  A text that is all repeated becomes empty."""
    kept = remove_repeats(docs, keep=["doc_id", "lang", "source"], with_text=True, span=PASSAGE)
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts' ids, packed into sequences of at most 4,096."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify),
    ("quality rules", judge_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("best-fit packing", pack),
]

#: SQL cannot express the learned stages or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with removed_after():  # what the stage wrote on its way
            docs = ws.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
