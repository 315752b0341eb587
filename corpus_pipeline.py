"""A corpus pipeline: toxicity, quality rules, near-duplicates, benchmark decontamination, packing.

Each stage takes what the one before kept, with all columns of ``documents``, and decides on its own input. The last puts out
pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motility.llm import toxicity
from motility.llm.common import Scratch, fresh
from motility.llm.decontaminate import find_leaks
from motility.llm.near_dedup import drop_near_duplicates
from motility.llm.packing import pack
from motility.llm.quality import judge_quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold of their language stay; the classifier learns from the labels of ``docs``.

    Null and empty texts are scored as texts without words; a null language has the common threshold. Long texts are scored whole. Every row is judged, repeated ones
    alike; a score at the threshold is over it. Columns of any name are kept; an empty table stays empty.
    """
    (name,) = fresh(docs.columns, "toxicity")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return model.scored(docs, name=name).where(~F.col(f"{name}.flagged")).drop(name)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules stay.

    Null, empty and other texts of fewer than ten words go. Long texts are judged whole. Every row is judged, repeated ones alike; a distance at its limit passes. Columns of any
    name are kept; an empty table stays empty.
    """
    (name,) = fresh(docs.columns, "quality")
    return judge_quality(docs, name=name).where(F.col(f"{name}.kept")).drop(name)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate texts the row with the least id stays; of rows with equal id and text, one.

    Rows of one id with texts that aren't alike all stay. Texts without words are alike to nothing. Null ids come last in a group. Columns of any name are kept; an empty
    table stays empty.
    """
    return drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item stay.

    Null and empty texts, and all where the benchmark is empty, stay. Long texts are searched whole. Every row is judged, repeated ones alike, and no tie matters. Columns of any
    name are kept; an empty table stays empty.
    """
    (name,) = fresh(docs.columns, "leak")
    return find_leaks(docs, _table(spark, sf_dir, "benchmark"), name=name).where(~F.col(f"{name}.contaminated")).drop(name)


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces of sequences with their token ids.

    Null and empty texts are an end id; long texts are tokenized whole. Rows with null or repeated ids are packed each; equal pieces are numbered in any order. Columns
    other than id and text are ignored; an empty table gives no rows.
    """
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_each),
    ("decontaminate", drop_contaminated),
    ("pack", pack_rest),
]

#: The classifier and the tokens are beyond SQL; the tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again. A stage's table is deleted once the next one stands."""
    scratch = Scratch(spark, "pipeline")
    docs, before = _table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [docs]
    packed = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written
    scratch.drop(*before)
    return packed
