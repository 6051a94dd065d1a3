"""How the sources of a language differ in their terms: divergences of pairs, and the terms that mark a source.

Terms are runs of ASCII letters and of characters beyond ASCII.  Shares of terms are smoothed and scaled to
integers, so all results are exact.  Most terms are missing from most sources, and all that are missing
from a source have one share there, the baseline.  So a pair's divergence is that of the two baselines for
every term, corrected by the terms that either source has: alone by a histogram of its counts against the
other's baseline, and by term only where both have it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .radix_select import top_k
from .workspace import Workspace, small_side, tidy

#: Documents of a language that a kept term is in, the scale of shares, and what is added to each count.
LEAST, SCALE, ADDED = 10, 1_000_000_000, 2
#: Bytes that stay as they are in a term, upper case lowered; all others separate terms.
_TERM = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Terms of a text in order, A-Z lower-cased."""
    return text.encode().translate(_TERM).split()


def term_counts(docs: DataFrame, hold: int = 300_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term; nulls are ''.

    Tasks add up before they hand on: at most ``hold`` different entries at a time.
    """
    fields = "lang string, source string, term string, n long, docs long"

    def packed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for (lang, source), (n, docs_) in held.items():
            for c, x in zip(cols, ([lang] * len(n), [source] * len(n), n.keys(), n.values(), map(docs_.__getitem__, n)), strict=True):
                c += x
        text = pa.array([t.decode() for t in cols[2]], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), text, pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], [f.split()[0] for f in fields.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for text, lang, source in zip(batch["text"], batch["lang"].to_pylist(), batch["source"].to_pylist(), strict=True):
                n, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                words = terms(text.as_py())
                n.update(words)
                docs_.update(set(words))
                size += len(n) - before
                if size >= hold:
                    yield packed(held)
                    held, size = {}, 0
        yield packed(held)

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return plain.mapInArrow(tidy(run), fields).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms_: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * terms)), without overflow."""
    wide = lambda x: x.cast("decimal(19,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * wide(count + ADDED)
    return F.call_function("div", above, wide(total + ADDED * terms_)) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / (p + q)); shares are below 2**31, so their squares fit."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def source_divergence(docs: DataFrame, k: int = 10, least: int = LEAST) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) that occurs.

    part ``pair``: each other source of the lang as item, the divergence of the two as value, all ranks.  part
    ``term``: the ``k`` terms whose share in the source is most above that in its lang.  Equal values are ranked by
    item in UTF-8 order.

    Null text, lang and source are ''.  A lang without kept terms has pairs of value 0 and no terms.  A group without
    terms has the baseline everywhere.  Repeated rows, of one doc_id or not, are documents of their own.  No rows
    give no rows.  Extra columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "audit")
    counts = ws.save(term_counts(docs), "counts")
    kept = ws.save(counts.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"), "kept")
    sparse = counts.select("lang", "source", "term", "n").join(small_side(kept), ["lang", "term"])
    sparse = ws.save(sparse, "sparse")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("lang_total"))
    totals = sparse.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = groups.withColumn("base", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("v"))))
    groups = ws.save(groups, "groups")
    shares = sparse.join(small_side(groups), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v")))
    shares = ws.save(shares.select("lang", "source", "term", "n", "of_lang", "lang_total", "v", "p", "base"), "shares")
    ws.drop("counts", "sparse")

    marks = shares.withColumn("q", _share(F.col("of_lang"), F.col("lang_total"), F.col("v"))).where("p > q")
    marks = ws.save(marks.select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value")), "marks")
    marks = top_k(marks, ["lang", "source"], "value", "item", k, ws).withColumn("part", F.lit("term"))

    pairs = ws.save(_pairs(shares, groups), "pairs")
    # every other source of a lang, so as many rows as the result has for it
    pairs = pairs.withColumn("rank", F.expr("row_number() over (partition by lang, source order by value desc, item)")).withColumn("part", F.lit("pair"))
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*order).unionByName(marks.select(*order))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of different sources of a lang."""
    one = groups.select("lang", "source", "v", "base")
    other = small_side(one.select("lang", F.col("source").alias("item"), F.col("base").alias("other")))
    both = _apart(F.col("base"), F.col("other"))
    ground = one.join(other, "lang").where("source <> item").select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * both).otherwise(F.lit(0).cast("long")).alias("value"))
    # terms of a source against the other's baseline: as many rows as it has different counts
    counts = shares.groupBy("lang", "source", "p", "base").agg(F.count("*").alias("times"))
    alone = counts.join(other, "lang").where("source <> item")
    alone = alone.select("lang", "source", "item", (F.col("times") * (_apart(F.col("p"), F.col("other")) - both)).alias("value"))
    x, y = shares.select("lang", "term", "source", "p", "base"), shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r"), F.col("base").alias("other"))
    met = x.join(y, ["lang", "term"]).where("source < item")
    change = _apart(F.col("p"), F.col("r")) - _apart(F.col("p"), F.col("other")) - _apart(F.col("base"), F.col("r")) + both
    met = met.groupBy("lang", "source", "item").agg(F.sum(change).alias("value"))
    turned = lambda df: df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return ground.unionByName(turned(alone)).unionByName(turned(met)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
