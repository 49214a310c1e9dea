"""The corpus pipeline: documents -> language -> near copies -> benchmark -> mixture -> token files.

Each stage takes (spark, docs, sf_dir), works on everything the stage before
it kept and is written as Parquet in the shared folder. All but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from funnelkit.llm import decontam, langid, mixing, simhash, tokenbin
from funnelkit.llm.common import documents, saved


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts whose positions agree on no language."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash component."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an item of `benchmark` stands."""
    return decontam.decontaminate(docs, decontam.read_benchmark(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens meet the source, language and topic targets."""
    return mixing.sampled(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the sample and reads the files back: doc_id, start, n_tokens, ids_crc32."""
    return tokenbin.token_table(docs)


STAGES = [
    ("identify_language", identify_language),
    ("drop_near_copies", drop_near_copies),
    ("drop_benchmark_leaks", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
    ("write_token_files", write_token_files),
]

#: Trained models, SimHash and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and reread as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
