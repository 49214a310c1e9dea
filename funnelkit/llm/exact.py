"""Operator 4: skew-safe exact deduplication.

Texts are equal when identical after each run of white space became one space.

1. *Locally*: before any shuffle each task combines its own equal texts.
2. *Salted*: what the tasks kept is merged by (digest, salt, text); the salt is
   the task's number, so copies of a hot text spread over `SALTS` reducers and
   each sends one row.
3. *Globally*: the salt winners, at most `SALTS` a text, meet by digest.

The whole text is part of the grouping key at every stage, so two texts with
one digest never merge. Rows find their group again by digest, and where a
digest has several texts (counted, kept with their text) by digest and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import saved

SALTS = 16
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _rows(docs: DataFrame, digest) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("body"))
    return rows.select("doc_id", "body", digest(F.col("body")).alias("digest"))


def groups(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """(digest, variants, body, keep_id, group_size), one row a text; body only where a digest has several texts."""
    lowest, size = F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    rows = _rows(docs, digest).withColumn("salt", F.spark_partition_id() % salts)
    salted = rows.groupBy("digest", "salt", "body").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    whole = salted.repartition("digest").groupBy("digest", "body").agg(lowest, size)
    whole = whole.withColumn("variants", F.count(F.lit(1)).over(Window.partitionBy("digest")))
    return whole.select("digest", "variants", F.when(F.col("variants") > 1, F.col("body")).alias("body"),
                        "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row, dropped ones too.

    keep_id is the smallest doc_id of the equal texts; `kept` marks the rows
    with that id. Null counts as empty text; texts are compared whole. Rows that
    repeat with the same doc_id count each and are kept alike. Null doc_ids
    never win over an id; if a group has none, keep_id is null and its rows are
    kept. An empty table gives an empty result; extra columns are not read.
    """
    found = saved(groups(docs, salts, digest), "exact-groups")
    rows = _rows(docs, digest)
    plain = found.where("variants = 1").select(F.col("digest").alias("__digest"), "keep_id", "group_size")
    mixed = found.where("variants > 1").select(F.col("digest").alias("__digest"), F.col("body").alias("__body"),
                                               "keep_id", "group_size")
    hashed = rows.select("doc_id", "digest", F.sha2("body", 256).alias("text_sha256"))
    out = hashed.join(plain, F.col("digest") == F.col("__digest")).select(
        "doc_id", "keep_id", "group_size", "text_sha256")
    if not mixed.isEmpty():
        same = (F.col("digest") == F.col("__digest")) & (F.col("body") == F.col("__body"))
        out = out.union(rows.join(mixed, same).select("doc_id", "keep_id", "group_size",
                                                      F.sha2("body", 256).alias("text_sha256")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""
