"""The corpus pipeline, stage by stage against brute force, and the queries with SQL against DuckDB."""

import os

import duckdb
import pytest

import corpus_pipeline
from motility.llm import oracles, queries
from motility.llm.common import written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", ["op2_decontaminate", "op3_quality", "op4_shard", "op8_url_rules", "op10_near_dedup"])
def test_sql(spark, duck, name):
    sql = oracles.op4() if name == "op4_shard" else oracles.all_sql()[name]
    found = duck.sql(sql)
    rows = sorted(map(str, found.fetchall()))
    df = getattr(queries, name)(spark, DATA).select(*found.columns)
    assert rows == sorted(str(tuple(r)) for r in df.collect())


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, DATA), name)
        assert out.columns == columns
        assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.select("doc_id").distinct().count() == out.count()
        seen.append(out.count())
        docs = out
    assert 0.3 * seen[0] < seen[-1] < seen[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert pieces.count() == corpus_pipeline.run(spark, DATA).count()


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", "en"), (1, "a b c d e f g h i j", "en"), (1, "other words", "en"), (None, None, None)], "doc_id long, text string, lang string")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.keep_one_of_each(spark, docs, DATA).collect()) == ["1", "1", "None"]
