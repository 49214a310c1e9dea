"""The operators as registered queries over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm import (chat, decontam, exact, hardneg, langid, mixing, pii, simhash, tokenbin, toxicity, urls, warc,
                           whitening)
from funnelkit.llm.common import documents


def op1_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs))


def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_table(documents(spark, sf_dir))


def op6_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(documents(spark, sf_dir), decontam.read_benchmark(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_pii_skip_chain, op2_chat_snapshots, op3_url_templates, op4_exact_dedup, op5_token_files, op6_toxicity_neighbours,
    op7_source_mix, op8_simhash_near_dedup, op9_benchmark_leaks, op10_language_id, op11_embedding_whitening,
    op12_hard_negatives, op13_warc_records)}

#: What DuckDB can restate; the others are held against brute force, round trips or held-out accuracy in tests/llm.
ORACLE_SQL: dict[str, str] = {"op2_chat_snapshots": chat.ORACLE_SQL, "op4_exact_dedup": exact.ORACLE_SQL,
                              "op12_hard_negatives": hardneg.ORACLE_SQL, "op13_warc_records": warc.ORACLE_SQL}
