"""Operator 2: chat formatting after cumulative-snapshot collapse. DataFrame functions only.

A logger that writes a conversation after every turn leaves snapshots: each is
a prefix of the next. Every turn gets a rolling hash of the turns up to it; a
conversation whose last hash stands at an earlier turn of another one is a
prefix of it and goes (anti-join), and of equal conversations the one with the
smallest conv_id stays. What is left is rendered.

The rolling hash is the xor of two 64-bit hashes of (position, role, text) over
the turns so far: positions differ within a conversation, so equal hashes mean
equal prefixes but for 2**-128. Being an xor it needs no order inside a chunk
of turns: positions and prefix sums are taken in chunks of `CHUNK` turn numbers
and shifted by the totals of the chunks before, so a conversation that holds a
third of all rows spreads over its chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import saved

CHUNK = 256
SEEDS = (42, 4242)


def render_turn(role: Column, text: Column) -> Column:
    """One turn of the template; a null role counts as `unknown`, a null text as empty."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("unknown")), F.lit("\n"),
                    F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, chunk, pos, role, text): turns numbered from 1 by turn, then role, then text.

    Rows without a turn number come first. Rows that repeat whole are one turn.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.distinct().withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("chunk"))
    starts = sizes.select(F.col("conv_id").alias("__conv"), F.col("chunk").alias("__chunk"),
                          (F.sum("n").over(order) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy(
        F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    return (rows.withColumn("inner", inner)
            .join(starts, F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("chunk").eqNullSafe(F.col("__chunk")))
            .select("conv_id", "chunk", (F.col("before") + F.col("inner")).alias("pos"), "role", "text"))


def prefixes(numbered: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2): the rolling hash of each turn prefix."""
    marks = [F.xxhash64(F.lit(s), "pos", F.isnull("role"), "role", F.isnull("text"), "text") for s in SEEDS]
    rows = numbered.select("conv_id", "chunk", "pos", marks[0].alias("m1"), marks[1].alias("m2"))
    inner = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "chunk", "pos", *[F.bit_xor(m).over(inner).alias(m) for m in ("m1", "m2")])
    last = rows.groupBy("conv_id", "chunk").agg(F.max_by("m1", "pos").alias("t1"), F.max_by("m2", "pos").alias("t2"))
    before = (Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("chunk"))
              .rowsBetween(Window.unboundedPreceding, -1))
    shift = last.select(F.col("conv_id").alias("__conv"), F.col("chunk").alias("__chunk"),
                        *[F.coalesce(F.bit_xor(t).over(before), F.lit(0)).alias(t) for t in ("t1", "t2")])
    joined = rows.join(shift, F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("chunk").eqNullSafe(F.col("__chunk")))
    return joined.select("conv_id", "pos", F.col("m1").bitwiseXOR(F.col("t1")).alias("h1"),
                         F.col("m2").bitwiseXOR(F.col("t2")).alias("h2"))


def collapse(rolled: DataFrame) -> DataFrame:
    """(conv_id, n_turns, kept, absorbed_by) for each conversation.

    absorbed_by: the smallest conv_id among the kept conversations that start
    with this one (null for kept ones).
    """
    key = ["pos", "h1", "h2"]
    ends = rolled.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("end")).select("conv_id", "end.*")
    classes = ends.groupBy(*key).agg(F.min("conv_id").alias("lead"))
    inner = rolled.join(ends.select(F.col("conv_id").alias("__conv"), F.col("pos").alias("__last")),
                        F.col("conv_id").eqNullSafe(F.col("__conv"))).where("pos < __last")
    longest = classes.join(inner.select(*key).distinct(), key, "left_anti")
    leads = longest.select(F.col("lead").alias("__lead"), F.lit(True).alias("__is_lead"))
    starts = (rolled.join(leads, F.col("conv_id").eqNullSafe(F.col("__lead")))
              .groupBy(*key).agg(F.min("conv_id").alias("absorbed_by")))
    return (ends.join(starts, key, "left")
            .select("conv_id", F.col("pos").alias("n_turns"),
                    F.col("absorbed_by").eqNullSafe(F.col("conv_id")).alias("kept"),
                    F.when(~F.col("absorbed_by").eqNullSafe(F.col("conv_id")), F.col("absorbed_by")).alias("absorbed_by")))


def rendered_turns(numbered: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, pos, rendered) of the kept conversations: the pieces of each rendering, in order of pos."""
    own = kept.where("kept").select(F.col("conv_id").alias("__conv"))
    return (numbered.join(own, F.col("conv_id").eqNullSafe(F.col("__conv")), "left_semi")
            .select("conv_id", F.col("pos").alias("turn_no"), render_turn(F.col("role"), F.col("text")).alias("rendered")))


def collapse_and_render(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, rendered turns). Decisions: conv_id, n_turns, kept, absorbed_by.

    Null conv_ids form one conversation; null turns come first; null texts and
    roles are values of their own; rows that repeat whole count once; ties of
    turn numbers are ordered by role and text. An empty table gives two empty
    results; extra columns are not read; texts are read whole.
    """
    numbered = saved(turns(conversations), "chat-turns")
    decided = saved(collapse(saved(prefixes(numbered), "chat-prefixes")), "chat-decisions")
    return decided, rendered_turns(numbered, decided)


def report(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Every turn of every conversation's decision: kept ones with their rendered turns, absorbed ones with one row."""
    decided, pieces = collapse_and_render(conversations)
    gone = decided.where("not kept").select("conv_id", F.lit(0).cast("long").alias("turn_no"), "n_turns", "kept",
                                            "absorbed_by", F.lit(None).cast("string").alias("rendered"))
    whole = decided.where("kept").select(F.col("conv_id").alias("__conv"), "n_turns", "kept", "absorbed_by")
    held = (pieces.join(whole, F.col("conv_id").eqNullSafe(F.col("__conv")))
            .select("conv_id", F.col("turn_no").cast("long").alias("turn_no"), "n_turns", "kept", "absorbed_by", "rendered"))
    return held.union(gone)


ORACLE_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations),
n AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM t),
r AS (
  SELECT conv_id, pos, role, text,
         list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY pos) AS upto
  FROM n),
e AS (SELECT conv_id, max(pos) AS n_turns, max_by(upto, pos) AS whole FROM r GROUP BY conv_id),
c AS (SELECT whole, min(conv_id) AS lead FROM e GROUP BY whole),
m AS (
  SELECT lead, whole FROM c
  WHERE NOT EXISTS (SELECT 1 FROM r JOIN e ON r.conv_id = e.conv_id WHERE r.pos < e.n_turns AND r.upto = c.whole)),
a AS (
  SELECT e.conv_id, e.n_turns, min(r.conv_id) AS target
  FROM e JOIN r ON r.upto = e.whole JOIN m ON m.lead = r.conv_id GROUP BY e.conv_id, e.n_turns)
SELECT a.conv_id, n.pos AS turn_no, a.n_turns, true AS kept, CAST(NULL AS BIGINT) AS absorbed_by,
       '<|im_start|>' || coalesce(n.role, 'unknown') || chr(10) || coalesce(n.text, '') || '<|im_end|>' || chr(10) AS rendered
FROM a JOIN n ON n.conv_id = a.conv_id WHERE a.target = a.conv_id
UNION ALL
SELECT conv_id, 0, n_turns, false, target, NULL FROM a WHERE target <> conv_id
"""
