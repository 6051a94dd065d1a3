"""The queries opN_<name>: thin digests of the operators' results, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .class_lm import class_lm_scores_of_documents
from .codec import encode_decode_digests
from .embedding_dedup import near_vectors
from .language import language_of_documents
from .lexical_search import search, write_index
from .ngram_join import ngram_jaccard_components
from .packing import pack_documents
from .phrase_automata import remove_earlier_phrases
from .quality import quality_verdicts
from .sharding import balanced_shards
from .source_audit import source_divergence
from .suffix_dedup import remove_repeats
from .token_files import read_token_files, write_token_files
from .workspace import Workspace


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_documents(spark, sf_dir))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_documents(_documents(spark, sf_dir))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{Workspace(spark, 'token_files').root}/ids"
    write_token_files(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), out)
    return read_token_files(spark, out)


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm_scores_of_documents(_documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = balanced_shards(_documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_earlier_phrases(_documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{Workspace(spark, 'lexical').root}/index"
    write_index(_documents(spark, sf_dir), out)
    return search(spark, out, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


#: Words of a text: A-Z lower-cased, cut at the six ASCII white-space characters.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

OP1_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

OP10_SQL = """
WITH RECURSIVE good AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) >= 0.9::DOUBLE * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.other),
named AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM named LEFT JOIN degree USING (vec_id)
"""

OP8_SQL = """
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
bytes AS (SELECT doc_id, strlen(s) + 8 AS size,
        list_transform(regexp_extract_all(hex(s), '..'), lambda p: CAST('0x' || p AS BIGINT)) AS b FROM raw),
crcs AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS text_crc32
        FROM bytes, steps),
sums AS (SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte,
        CAST(sum(size) OVER () AS BIGINT) AS total FROM crcs),
cut AS (SELECT *, CAST(least(23, byte * 24 // total) AS INTEGER) AS shard FROM sums)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

OP11_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
firsts AS (SELECT p, min(doc_id) AS first FROM windows GROUP BY p),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS g FROM windows JOIN firsts USING (p) WHERE first < doc_id GROUP BY doc_id),
kept AS (SELECT doc_id, w, list_filter(w, lambda x, i: NOT list_contains(g, i)) AS k FROM words JOIN gone USING (doc_id)
  UNION ALL SELECT doc_id, w, w FROM words ANTI JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(k) AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c, 1 + (1000000000 * (coalesce(x.c, 0)::HUGEINT + 2)) // (coalesce(s.n, 0) + 2 * l.v) AS p, 1 + (1000000000 * (k.c::HUGEINT + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
marks AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM dense WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marks))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

OP13_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT row, sum(tf) AS n FROM tf GROUP BY row),
s AS (SELECT count(*) AS docs, sum(n) AS total FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM q JOIN df USING (term), s GROUP BY item_id, term, docs, df),
scores AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n.n * docs) // total)))) AS score
  FROM asked JOIN tf USING (term) JOIN n USING (row), s GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_language_id": op3_language_id,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_files": op6_token_files,
    "op7_class_lm": op7_class_lm,
    "op8_sharding": op8_sharding,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op8_sharding": OP8_SQL,
    "op10_embedding_dedup": OP10_SQL,
    "op11_substring_dedup": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
