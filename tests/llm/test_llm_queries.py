import duckdb
import pytest

import corpus_pipeline
from loomspan.llm.queries import ORACLE_SQL, QUERIES
from loomspan.session import ship_package


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    ship_package(spark)
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == sorted(tuple(map(str, r)) for r in found.fetchall())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir).persist()
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append(docs.count())
    assert kept[0] >= kept[1] > kept[2] > kept[3] > 0.5 * kept[0]
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert rows.groupBy("sequence_id").sum("length").selectExpr("max(`sum(length)`)").first()[0] <= 4096


def test_pipeline_without_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
