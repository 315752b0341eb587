"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motility.llm import language_id, lm_score, manifest, oracles, toxicity
from motility.llm.collocations import collocations
from motility.llm.common import ascii_lower
from motility.llm.decontaminate import find_leaks
from motility.llm.html_blocks import extract
from motility.llm.near_dedup import near_duplicates
from motility.llm.packing import pack
from motility.llm.quality import judge_quality
from motility.llm.quotes import reply_threads
from motility.llm.sharding import shard
from motility.llm.url_rules import judge_urls

#: The rules of the URL query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.fit(docs).scored(docs, keep=["doc_id"]).select("doc_id", "lm.n_tokens", "lm.log_prob", "lm.mean_log_prob")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *(f"leak.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    distances = (F.round(f"quality.{c}", 6).alias(c) for c in ("char_distance", "common_distance"))
    return judged.select("doc_id", *(f"quality.{c}" for c in fields), *distances)


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = shard(sized, "doc_id", 8, order=["size", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op5_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_threads(_table(spark, sf_dir, "conversations"))


def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, name="text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity.fit(docs, _table(spark, sf_dir, "labels")).scored(docs)
    score = F.col("toxicity.score")
    held = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return scored.select("doc_id", held, score.alias("score"), (score >= 0.7).cast("int").alias("predicted"), "toxicity.threshold", "toxicity.flagged")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


def op12_language(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.fit(docs, vocabulary).identified(docs.select("doc_id", "text"))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    sealed = manifest.seal(docs, found={"text": F.when(tampered, ascii_lower(F.col("text"))).otherwise(F.col("text"))})
    return sealed.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (
        op1_lm_score, op2_decontaminate, op3_quality, op4_shard, op5_quotes, op6_html_blocks, op7_toxicity, op8_url_rules, op9_pack, op10_near_dedup,
        op11_collocations, op12_language, op13_manifest, pipeline,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
