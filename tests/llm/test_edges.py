"""Every corpus operator and pipeline stage on nulls, empty and very long texts, repeats, empty tables and columns whose names clash with those used inside."""

import collections

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motility.llm import collocations, language_id, lm_score, manifest, packing, quality, quotes, sharding, toxicity, url_rules
from motility.llm.common import written
from motility.llm.decontaminate import find_leaks
from motility.llm.html_blocks import extract
from motility.llm.near_dedup import drop_near_duplicates, near_duplicates

DATA = "/root/testdata/sf0.001"
CLASHES = (
    "n b before local bucket tie place part row got key found toxicity quality leak row_key digest text_ words_ n_ lang_ counted_ ref_chars_ ref_common_ char_ common_ hash h words share lm spans items "
    "_id _row _text _lang _y _n _b _before _local _bucket _tie _place _found _kept _leak _c _words _quality _toxicity node component comp range shares batch first grp digest seen subroot one kind block run w1 w2 phrase f gid language docs"
).split()
LONG = "the word of a long text and more " * 60_000
ROWS = [
    (1, "a few words of a text that is no more than it is and so on", "en"), (1, "a few words of a text that is no more than it is and so on", "en"), (2, None, "en"), (3, "", None), (None, "no id here but words enough to be judged at all", "de"),
    (None, None, None), (4, " \n\t ", "xx"), (5, LONG, "en"), (6, "x" * 300_000, "en"), (1, "another text of the same id that has some other words in it", "en"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return written(spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(f"mine {c}") for c in CLASHES}), "edges")


def rows_of(df, columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


OPERATORS = {
    "op1": lambda d: lm_score.fit(d.select("doc_id", "text")).scored(d, name="added"),
    "op2": lambda d: find_leaks(d, d.sparkSession.read.parquet(f"{DATA}/benchmark.parquet"), name="added"),
    "op2 by shuffles": lambda d: find_leaks(d, d.sparkSession.read.parquet(f"{DATA}/benchmark.parquet"), name="added", broadcast_bytes=0),
    "op3": lambda d: quality.judge_quality(d, name="added"),
    "op3 with joined references": lambda d: quality.judge_quality(d, name="added", small_refs=0),
    "op4": lambda d: sharding.shard(d),
    "op6": lambda d: extract(d, "text", name="added"),
    "op7": lambda d: toxicity.fit(d, d.sparkSession.read.parquet(f"{DATA}/labels.parquet")).scored(d, name="added"),
    "op12": lambda d: language_id.fit(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).identified(d, name="added"),
    "op8": lambda d: url_rules.judge_urls(d, d.sparkSession.createDataFrame([("a", "/", "block")], "host string, path string, verdict string"), "text"),
    "op8 by ranges": lambda d: url_rules.judge_urls(d, d.sparkSession.createDataFrame([("a", "/", "block")], "host string, path string, verdict string"), "text", broadcast_rows=0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_and_columns_come_through(docs, name):
    out = OPERATORS[name](docs)
    assert rows_of(out, docs.columns) == rows_of(docs, docs.columns)
    assert len(out.columns) == len(set(out.columns)) > len(docs.columns)
    none = OPERATORS[name](docs.limit(0))
    assert none.columns == out.columns and none.count() == 0


def test_a_column_of_the_added_name_is_replaced(docs):
    named = docs.withColumn("leak", F.lit(1)).withColumn("quality", F.lit(1))
    assert "struct" in dict(find_leaks(named, docs.sparkSession.read.parquet(f"{DATA}/benchmark.parquet")).dtypes)["leak"]
    assert "struct" in dict(quality.judge_quality(named).dtypes)["quality"]


def test_operators_with_rows_of_their_own(docs):
    n = len(ROWS)
    assert near_duplicates(docs).count() == n and near_duplicates(docs.limit(0)).count() == 0
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == n - 1
    packed = packing.pack(docs, with_ids=False)
    assert packed.where("start = 0").count() == n and packing.pack(docs.limit(0)).count() == 0
    seal = lambda d: manifest.seal(d, ("doc_id", "text", "seen"), group_col="lang")
    assert rows_of(seal(docs), ["doc_id", "lang"]) == rows_of(docs, ["doc_id", "lang"]) and seal(docs.limit(0)).count() == 0
    phrases = collocations.collocations(docs, least=50_000)
    assert {r.phrase for r in phrases.collect()} == {" ".join((LONG.split() * 2)[i : i + 3]) for i in range(8)} and collocations.collocations(docs.limit(0)).count() == 0
    talk = docs.select("*", F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("u").alias("role"))
    assert quotes.reply_threads(talk).count() == n and quotes.reply_threads(talk.limit(0)).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, docs, stage):
    out = stage[1](spark, docs, DATA)
    assert out.columns == docs.columns
    got, want = rows_of(out, docs.columns), rows_of(docs, docs.columns)
    assert not got - want
    gone = {"toxicity": 0, "near_dedup": 1, "decontaminate": 0}.get(stage[0])
    assert gone is None or sum((want - got).values()) == gone
    if stage[0] == "quality":
        assert all(len((r[1] or "").split()) >= 10 for r in got)
    none = stage[1](spark, docs.limit(0), DATA)
    assert none.columns == docs.columns and none.count() == 0


def test_last_stage(spark, docs):
    assert corpus_pipeline.pack_rest(spark, docs, DATA).where("start = 0").count() == len(ROWS)
    assert corpus_pipeline.pack_rest(spark, docs.limit(0), DATA).count() == 0
