"""Operator 7: mix sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic) with token totals. Raking
scales the cells' token weights until the source, language and topic marginals
meet their targets. No document is kept more than once, so the sample is raked again with
probability 1 as a bound: cells that reach it stay there and the others make up
for them, until the sample's expected tokens meet the targets. A value with fewer
tokens than its target asks for gives all it has, the other values share the rest.
Each document is then kept with its cell's probability, by a hash of its id, so a
rerun of a lost task decides alike.

Topic: the bucket of the document's leading keyword, its most frequent word of
`KEYWORD_LETTERS` or more letters (ties: the smallest word); texts without one
have topic "none". Buckets are crc32(word) mod `TOPICS`. Tokens are words.

Cells are bounded: a dimension keeps the values its targets name (at most
`MAX_VALUES`) and folds all others into one, so the driver holds at most
(sources + 1) x (languages + 1) x (topics + 1) cells, which is checked.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.common import saved, text_batches, texts_of

DIMENSIONS = ("source", "lang", "topic")
TOPICS = 8
KEYWORD_LETTERS = 6
TEMPERATURE = 0.5         # default targets: shares to this power, so that large sources weigh less
KEEP_SHARE = 0.5          # of all tokens, expected in the sample
MAX_VALUES = 1000
MAX_CELLS = 2_000_000
ROUNDS, TOLERANCE = 200, 1e-9
OTHER, MISSING = "*other*", "*null*"
SEED = 7

_KEYWORD = re.compile(r"[^\W\d_]{%d,}" % KEYWORD_LETTERS)


def topic(text: str) -> str:
    found = Counter(_KEYWORD.findall(text.lower()))
    if not found:
        return "none"
    top = max(found.values())
    word = min(w for w, n in found.items() if n == top)
    return f"topic{zlib.crc32(word.encode('utf-8', 'surrogatepass')) % TOPICS}"


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        texts = texts_of(batch)
        yield pa.RecordBatch.from_arrays(
            [*(c for n, c in zip(batch.schema.names, batch.columns) if n != "text"),
             pa.array(list(map(topic, texts)), pa.string()), pa.array([len(t.split()) for t in texts], pa.int64())],
            [*(n for n in batch.schema.names if n != "text"), "topic", "tokens"])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) for every row and whole text; null source or lang: `*null*`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in ("source", "lang")],
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_with_features, "doc_id long, source string, lang string, topic string, tokens long")


@dataclass
class Plan:
    """Cells and what raking gave them: one probability a cell; `expected`: the sample's shares of tokens by dimension."""

    values: dict[str, list[str]]
    cells: list[tuple[str, str, str]]
    tokens: np.ndarray
    weights: np.ndarray
    probability: np.ndarray
    expected: dict[str, dict[str, float]]


def default_targets(feats: DataFrame, temperature: float = TEMPERATURE) -> dict[str, dict[str, float]]:
    """Token shares of the values present, to the power `temperature`, normalised.

    The `MAX_VALUES` largest values of a dimension get a target of their own,
    all others share one, so a dimension of any size is covered.
    """
    out = {}
    for d in DIMENSIONS:
        sums = feats.groupBy(d).agg(F.sum("tokens").alias("n")).where("n > 0")
        top = sums.orderBy(F.desc("n"), d).limit(MAX_VALUES + 1).collect()
        named = {r[d]: float(r["n"]) for r in top[:MAX_VALUES]}
        if len(top) > MAX_VALUES:
            named[OTHER] = float(sums.agg(F.sum("n")).first()[0]) - sum(named.values())
        share = {k: v ** temperature for k, v in named.items()}
        whole = sum(share.values()) or 1.0
        out[d] = {k: v / whole for k, v in share.items()}
    return out


def folded(name: str, named: list[str]):
    """The dimension's value if it has a target, else `*other*`."""
    return F.when(F.col(name).isin(named), F.col(name)).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


def rake(cells: list[tuple], tokens: np.ndarray, targets: dict[str, dict[str, float]]) -> np.ndarray:
    """Iterative proportional fitting from `tokens`: weights that sum to 1 and meet the marginal targets.

    Targets are renormalised over the values that have tokens. Stops once every
    marginal is within `TOLERANCE`, or after `ROUNDS` rounds if the targets
    contradict each other.
    """
    w = tokens.astype(np.float64) / max(1, tokens.sum())
    codes, wanted = _coded(cells, targets)
    for _ in range(ROUNDS):
        worst = 0.0
        for code, goal in zip(codes, wanted):
            have = np.bincount(code, w, len(goal))
            worst = max(worst, float(np.abs(have - goal).max(initial=0.0)))
            w = w * np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)[code]
        if worst < TOLERANCE:
            break
    return w


def _coded(cells: list[tuple], targets: dict[str, dict[str, float]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each dimension: the cells' value numbers (values ascending) and the values' targets, normalised."""
    codes, wanted = [], []
    for k, d in enumerate(DIMENSIONS):
        names = sorted({c[k] for c in cells})
        at = {v: i for i, v in enumerate(names)}
        codes.append(np.array([at[c[k]] for c in cells], np.int64))
        goal = np.array([targets[d].get(v, 0.0) for v in names])
        wanted.append(goal / (goal.sum() or 1.0))
    return codes, wanted


def rake_bounded(cells: list[tuple], tokens: np.ndarray, targets: dict[str, dict[str, float]], weights: np.ndarray,
                 budget: float) -> np.ndarray:
    """Probabilities min(1, product of one factor a value) from `weights` whose expected tokens meet the targets x `budget`.

    Targets beyond a value's tokens are cut to them, the rest goes to the
    dimension's other values in proportion.
    """
    codes, wanted = _coded(cells, targets)
    goals = []
    for code, goal in zip(codes, wanted):
        there = np.bincount(code, tokens, len(goal))
        goals.append(calibrate(goal, there, budget) * there)
    u = budget * np.divide(weights, tokens, out=np.zeros_like(weights), where=tokens > 0)
    for _ in range(ROUNDS):
        worst = 0.0
        for code, goal in zip(codes, goals):
            have = np.bincount(code, tokens * np.minimum(1.0, u), len(goal))
            worst = max(worst, float(np.abs(have - goal).max(initial=0.0)))
            u = np.minimum(u * _factors(u, tokens, code, goal)[code], 1e100)
        if worst < TOLERANCE * max(1.0, budget):
            break
    return calibrate(tokens * np.minimum(1.0, u), tokens, budget)


def _factors(u: np.ndarray, tokens: np.ndarray, code: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """f of each value with sum of tokens x min(1, f x u) = goal: Newton steps from below on a concave function."""
    have = np.bincount(code, tokens * u, len(goal))
    f = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
    for _ in range(100):
        full = f[code] * u >= 1
        free = np.bincount(code, np.where(full, 0.0, tokens * u), len(goal))
        left = goal - np.bincount(code, tokens * full, len(goal))
        new = np.maximum(f, np.divide(left, free, out=f.copy(), where=free > 1e-12 * have))
        if (new <= f * (1 + 1e-14)).all():
            break
        f = new
    return f


def calibrate(weights: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, scale x weight / tokens) whose expected tokens meet `budget` as far as they can."""
    ratio = np.divide(weights, tokens, out=np.zeros_like(weights), where=tokens > 0)
    order = np.argsort(-ratio, kind="stable")
    full, left = 0.0, float(weights.sum())
    scale = 0.0
    for i in order:  # cells reach probability 1 in this order
        scale = (budget - full) / left if left > 0 else 0.0
        if scale * ratio[i] <= 1 or ratio[i] == 0:
            break
        full += tokens[i]
        left -= weights[i]
    else:
        scale = np.inf
    return np.where(ratio > 0, np.minimum(1.0, np.where(np.isinf(scale), 1.0, scale * ratio)), 0.0)


def plan(feats: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep_share: float = KEEP_SHARE) -> Plan:
    """Cells with token totals over all documents, raked and calibrated."""
    targets = targets or default_targets(feats)
    values = {d: sorted(v for v in targets[d] if v != OTHER) for d in DIMENSIONS}
    most = np.prod([len(v) + 1.0 for v in values.values()])
    if most > MAX_CELLS:
        raise ValueError(f"targets name up to {most:.0f} cells; at most {MAX_CELLS} are raked")
    rows = (feats.groupBy(*[folded(d, values[d]).alias(d) for d in DIMENSIONS])
            .agg(F.sum("tokens").alias("tokens")).orderBy(*DIMENSIONS).collect())
    cells = [tuple(r[d] for d in DIMENSIONS) for r in rows]
    tokens = np.array([r["tokens"] for r in rows], np.float64)
    weights = rake(cells, tokens, targets)
    chance = rake_bounded(cells, tokens, targets, weights, keep_share * tokens.sum())
    expected, kept = {}, tokens * chance
    for k, d in enumerate(DIMENSIONS):
        sums = Counter()
        for c, n in zip(cells, kept.tolist()):
            sums[c[k]] += n
        expected[d] = {v: n / (kept.sum() or 1.0) for v, n in sorted(sums.items())}
    return Plan(values, cells, tokens, weights, chance, expected)


def _cell_table(spark, p: Plan) -> DataFrame:
    rows = [(*c, float(w), float(q)) for c, w, q in zip(p.cells, p.weights, p.probability)]
    return spark.createDataFrame(rows, "`__source` string, `__lang` string, `__topic` string, __weight double, __p double")


def draw(doc_id, seed: int = SEED):
    """Uniform in [0, 1) from the document's id alone; a null id counts as empty text."""
    h = F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed))
    return h.bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def _decide(feats: DataFrame, p: Plan) -> DataFrame:
    """Adds __weight and __p of each row's cell; the cell table is bounded by `MAX_CELLS`."""
    cells = F.broadcast(_cell_table(feats.sparkSession, p))
    same = [folded(d, p.values[d]) == F.col(f"__{d}") for d in DIMENSIONS]
    return feats.join(cells, same[0] & same[1] & same[2], "left")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep_share: float = KEEP_SHARE) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, cell_weight, probability, draw, kept), one row for each row.

    Null source or lang is the value `*null*`; null or empty texts have 0
    tokens and follow their cell (probability 0 if its tokens are 0). Values
    without target fall into `*other*`, whose target is 0 unless given. Rows
    that share a doc_id draw alike. An empty table gives an empty result; extra
    columns are not read.
    """
    feats = saved(features(docs), "mix-features")
    out = _decide(feats, plan(feats, targets, keep_share))
    return out.select("doc_id", *DIMENSIONS, "tokens", F.col("__weight").alias("cell_weight"),
                      F.col("__p").alias("probability"), draw(F.col("doc_id")).alias("draw"),
                      (draw(F.col("doc_id")) < F.col("__p")).alias("kept"))


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The rows that `mix` keeps, all columns as they are; one map over the texts and one over the kept ones."""
    feats = saved(features(docs), "mix-features")
    p = plan(feats, targets, keep_share)
    chance = {c: float(q) for c, q in zip(p.cells, p.probability)}
    named = {d: frozenset(v) for d, v in p.values.items()}
    names = docs.columns
    at = "__draw"
    while at in names:
        at += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            cols = {d: [MISSING if v is None else str(v) for v in batch.column(d).to_pylist()] for d in ("source", "lang")}
            cols["topic"] = list(map(topic, texts_of(batch)))
            cells = zip(*[[v if v in named[d] else OTHER for v in cols[d]] for d in DIMENSIONS])
            keep = [u < chance.get(c, 0.0) for u, c in zip(batch.column(at).to_pylist(), cells)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    drawn = docs.withColumn(at, draw(F.col("doc_id")))
    return drawn.mapInArrow(run, docs.schema)
