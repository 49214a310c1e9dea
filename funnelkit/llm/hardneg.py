"""Hard-negative mining by a multiway hyperplane tree with range tables (GNAT).

A row's score is the integer inner product with the anchor. With M the largest
norm, the coordinate sqrt(M^2 - |x|^2) added to every row (0 for an anchor)
makes |anchor - x|^2 = |anchor|^2 + M^2 - 2 score: a window of scores is an
annulus of distances, the best scores its nearest points.

*Top level.* Split points are picked farthest-first from a bounded sample
(`SAMPLE` rows); each row of the table falls to its nearest one (a cell). For
each cell the smallest and largest distance to *every* split point is taken over
all rows. A cell is eliminated for an anchor and window as soon as, for one
split point, its range does not meet the window's annulus around the anchor.
*Below.* Cells are dealt into shards of about `SHARD_ROWS` rows. The task that
searches a shard builds the same tree in it, down to leaves, and runs a block of
anchors through it together; leaves compute all scores exactly.

An anchor first searches the shards of its own cell; the k-th score found there
narrows the window for the cells that are left. Nothing is approximate and
nothing is capped: the tree only skips what cannot hold a result.

Anchors are routed to shards by key and split into blocks of about
`BLOCK_ANCHORS`, so a group holds one shard and one block, whatever the size or
skew of labels and vectors (copies of one vector fill several shards).

Defined results: rows with a null vec_id, label or vector, or a null or
non-finite entry take no part, nor do vectors of another than the commonest
length or with a squared norm (in the integers) of 2^62 or more, whose scores
would not fit; repeated rows (same id, label and vector) count once; rows that
share an id but differ each take part, and no row is a partner of an anchor with
its own id; ties go to the smaller vec_id; an anchor without positives, or a
positive without negatives in the window, has no row; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import saved
from funnelkit.llm.whitening import integer_vectors

ANCHOR_EVERY = 100
RELABEL_EVERY, LABELS = 7, 10
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
SAMPLE, CELLS = 2048, 32
SHARD_ROWS, BLOCK_ANCHORS = 2048, 1024
FANOUT, LEAF_ROWS = 8, 128
MAX_NORM2 = 1 << 62

OUTPUT = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint,"
          " negative_score bigint")
ROWS = "vec_id bigint, label int, x array<bigint>, norm2 bigint"
FOUND = "qid bigint, tag bigint, cand_id bigint, score bigint"
QUERY = "qid bigint, anchor_id bigint, label int, x array<bigint>, norm2 bigint, cell int, tags array<bigint>, lo array<bigint>, hi array<bigint>"
ROUTED = f"{QUERY}, to_cell int, chunk int, block int"
NONE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


# ------------------------------------------------------------- geometry

@dataclass(frozen=True)
class Space:
    """M^2 and the dimension; distances in the space with the added coordinate."""

    m2: int
    d: int

    def matrix(self, values) -> np.ndarray:
        """Rows as doubles if all products stay exact in them, else as longs."""
        x = np.asarray(values, np.int64).reshape(-1, self.d)
        return x.astype(float) if self.m2 < 1 << 53 else x

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-6 * math.sqrt(4.0 * self.m2 + 1.0)

    def added(self, norm2: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((self.m2 - np.asarray(norm2, np.int64)).astype(float), 0.0))

    def between_rows(self, a, a_norm2, b, b_norm2) -> np.ndarray:
        inner = (a @ b.T).astype(float) + np.outer(self.added(a_norm2), self.added(b_norm2))
        return np.sqrt(np.maximum(2.0 * self.m2 - 2.0 * inner, 0.0))

    def from_anchor(self, a, a_norm2, b) -> np.ndarray:
        return self.radius(a_norm2[:, None], (a @ b.T))

    def radius(self, norm2, score) -> np.ndarray:
        """Distance of a row with that score from an anchor of that norm."""
        return np.sqrt(np.maximum(np.asarray(norm2).astype(float) + self.m2 - 2.0 * np.asarray(score).astype(float), 0.0))


def farthest_first(space: Space, x: np.ndarray, norm2: np.ndarray, k: int) -> list[int]:
    """Up to k row numbers, each the farthest from those before; equal rows are taken once."""
    picked = [0]
    near = space.between_rows(x, norm2, x[:1], norm2[:1])[:, 0]
    while len(picked) < min(k, len(x)):
        far = int(np.argmax(near))
        if near[far] <= space.slack:
            break
        picked.append(far)
        near = np.minimum(near, space.between_rows(x, norm2, x[far:far + 1], norm2[far:far + 1])[:, 0])
    return picked


def survivors(to_split: np.ndarray, lo: np.ndarray, hi: np.ndarray, inner: np.ndarray, outer: np.ndarray,
              slack: float) -> np.ndarray:
    """Which (anchor, cell) pairs are left: some window's annulus meets the cell's range at every split point.

    to_split: anchors x split points; lo, hi: split points x cells; inner, outer:
    anchors x windows, an empty window having inner > outer.
    """
    left = np.zeros((len(to_split), lo.shape[1]), bool)
    for w in range(inner.shape[1]):
        r_in, r_out = inner[:, w, None, None], outer[:, w, None, None]
        q = to_split[:, :, None]
        meets = (q - r_out <= hi + slack) & (q + r_out >= lo - slack) & (q + hi >= r_in - slack) & (lo - q <= r_out + slack)
        left |= meets.all(axis=1) & (inner[:, w] <= outer[:, w] + slack)[:, None]
    return left


# ------------------------------------------------------------- the tree inside a shard

class Tree:
    def __init__(self, space: Space, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norm2: np.ndarray) -> None:
        self.space, self.ids, self.labels, self.x, self.norm2 = space, ids, labels, x, norm2
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> tuple:
        if len(rows) <= LEAF_ROWS:
            return (rows,)
        tried = rows[:: max(1, len(rows) // (FANOUT * 16))]
        picked = tried[farthest_first(self.space, self.x[tried], self.norm2[tried], FANOUT)]
        to_split = self.space.between_rows(self.x[rows], self.norm2[rows], self.x[picked], self.norm2[picked])
        home = np.argmin(to_split, axis=1)
        parts = [home == j for j in range(len(picked)) if np.any(home == j)]
        if len(parts) < 2:
            return (rows,)
        lo = np.array([to_split[p].min(axis=0) for p in parts]).T
        hi = np.array([to_split[p].max(axis=0) for p in parts]).T
        return picked, lo, hi, [self._build(rows[p]) for p in parts]

    def search(self, block: Block) -> None:
        self._visit(self.root, np.arange(len(block.ids)), block)

    def _visit(self, node: tuple, active: np.ndarray, block: Block) -> None:
        if len(node) == 1:
            block.take(active, self.ids[node[0]], self.labels[node[0]], self.x[node[0]])
            return
        picked, lo, hi, children = node
        to_split = self.space.from_anchor(block.x[active], block.norm2[active], self.x[picked])
        for j in np.argsort(lo.min(axis=0), kind="stable"):
            inner, outer = block.annuli(active)
            left = survivors(to_split, lo[:, j:j + 1], hi[:, j:j + 1], inner, outer, self.space.slack)[:, 0]
            if left.any():
                self._visit(children[j], active[left], block)


class Block:
    """Anchors searched together: their windows and the best k rows of each so far."""

    def __init__(self, space: Space, ids, labels, x, norm2, lo, hi, same: bool, k: int) -> None:
        self.space, self.ids, self.labels, self.x, self.norm2 = space, ids, labels, x, norm2
        self.lo, self.hi, self.same, self.k = lo, hi, same, k
        self.score = np.full((*lo.shape, k), NONE)
        self.found = np.full((*lo.shape, k), NO_ID)

    def floor(self, active: np.ndarray) -> np.ndarray:
        """The lowest score that can still enter a window's best k."""
        return np.maximum(self.lo[active], self.score[active, :, -1])

    def annuli(self, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm2, floor = self.norm2[active, None], self.floor(active)
        inner = self.space.radius(norm2, self.hi[active])
        return inner, np.where(floor <= self.hi[active], self.space.radius(norm2, floor), -np.inf)

    def take(self, active: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        """Merges the rows of a leaf into the best k."""
        scores = (self.x[active] @ x.T).astype(np.int64)
        fits = (self.labels[active, None] == labels) == self.same
        fits &= self.ids[active, None] != ids
        floor = self.floor(active)
        for w in range(self.lo.shape[1]):
            in_window = fits & (scores >= floor[:, w, None]) & (scores <= self.hi[active, w, None])
            some = np.flatnonzero(in_window.any(axis=1))
            if not len(some):
                continue
            at = active[some]
            s = np.concatenate([self.score[at, w], np.where(in_window[some], scores[some], NONE)], axis=1)
            i = np.concatenate([self.found[at, w], np.where(in_window[some], ids, NO_ID)], axis=1)
            best = np.lexsort((i, ~s), axis=1)[:, :self.k]  # ~s falls as s rises and cannot overflow
            self.score[at, w] = np.take_along_axis(s, best, axis=1)
            self.found[at, w] = np.take_along_axis(i, best, axis=1)


# ------------------------------------------------------------- the top level

@dataclass(frozen=True)
class Top:
    """Split points, their range tables and the number of shards of each cell: bounded by `CELLS`."""

    space: Space
    points: np.ndarray
    norm2: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    shards: np.ndarray

    def cells(self, x: np.ndarray, norm2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest split point, distances to all) of rows."""
        to_split = self.space.between_rows(x, norm2, self.points, self.norm2)
        return np.argmin(to_split, axis=1), to_split


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x, norm2) of the rows that take part, written to the shared folder."""
    labelled = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL")
    moved = labelled.withColumn("label", F.expr(
        f"CAST(CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS INT)"))
    x = integer_vectors(moved, "label")
    rough = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    fits = x.where(rough < float(MAX_NORM2 * 0.999))
    exact = F.when(rough < float(MAX_NORM2), F.aggregate("x", F.lit(0).cast("bigint"), lambda a, v: a + v * v))
    return saved(fits.select("vec_id", "label", "x", exact.alias("norm2")).distinct(), "hardneg-rows")


def _arrays(batch: pa.RecordBatch | pa.Table, space: Space) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(batch, pa.Table):
        batch = batch.combine_chunks()
        flat = pa.concat_arrays([c.flatten() for c in batch.column("x").chunks]) if batch.num_rows else pa.array([], pa.int64())
    else:
        flat = batch.column("x").flatten()
    return space.matrix(flat.to_numpy(zero_copy_only=False)), batch.column("norm2").to_numpy(zero_copy_only=False)


def _ranges(top: Top):
    k = len(top.points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, n = np.full((k, k), np.inf), np.full((k, k), -np.inf), np.zeros(k, np.int64)
        for batch in batches:
            home, to_split = top.cells(*_arrays(batch, top.space))
            for j in np.unique(home):
                mine = to_split[home == j]
                lo[:, j], hi[:, j] = np.minimum(lo[:, j], mine.min(axis=0)), np.maximum(hi[:, j], mine.max(axis=0))
                n[j] += len(mine)
        split, cell = np.nonzero(np.isfinite(lo))
        yield pa.record_batch({"split": pa.array(split, pa.int32()), "cell": pa.array(cell, pa.int32()),
                               "lo": pa.array(lo[split, cell]), "hi": pa.array(hi[split, cell]), "n": pa.array(n[cell])})
    return run


def fit_top(rows: DataFrame) -> Top | None:
    """Split points from a bounded sample, ranges and counts over all rows; None if there is no row."""
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("m2")) \
        .orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return None
    space = Space(int(size["m2"]), int(size["d"]))
    drawn = rows.where(F.size("x") == space.d).orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE).select("x", "norm2").collect()
    x, norm2 = space.matrix([r["x"] for r in drawn]), np.array([r["norm2"] for r in drawn], np.int64)
    picked = farthest_first(space, x, norm2, CELLS)
    k = len(picked)
    top = Top(space, x[picked], norm2[picked], np.full((k, k), np.inf), np.full((k, k), -np.inf), np.zeros(k, np.int64))
    found = (rows.where(F.size("x") == space.d).mapInArrow(_ranges(top), "split int, cell int, lo double, hi double, n bigint")
             .groupBy("split", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect())
    for r in found:
        top.lo[r["split"], r["cell"]], top.hi[r["split"], r["cell"]] = r["lo"], r["hi"]
        top.shards[r["cell"]] = -(-r["n"] // SHARD_ROWS)
    return top


def _place(top: Top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = np.full(len(top.points), TaskContext.get().partitionId(), np.int64)
        for batch in batches:
            home, _ = top.cells(*_arrays(batch, top.space))
            chunk = np.zeros(len(home), np.int32)
            for j in np.unique(home):  # dealt in turn: shards of a cell differ by a row a task at most
                mine = np.flatnonzero(home == j)
                chunk[mine] = (seen[j] + np.arange(len(mine))) % top.shards[j]
                seen[j] += len(mine)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home, pa.int32()), pa.array(chunk, pa.int32())],
                names=[*batch.schema.names, "cell", "chunk"])
    return run


# ------------------------------------------------------------- searching

def _windows(lists_lo: list, lists_hi: list, m2: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows as anchors x windows, padded by empty ones, held within what a score can be."""
    width = max([len(v) for v in lists_lo], default=0)
    lo, hi = np.full((len(lists_lo), width), m2, np.int64), np.full((len(lists_lo), width), -m2, np.int64)
    for i, (a, b) in enumerate(zip(lists_lo, lists_hi)):
        lo[i, :len(a)] = [max(int(v), -m2) for v in a]
        hi[i, :len(b)] = [min(int(v), m2) for v in b]
    return lo, hi


def _route(top: Top, own: bool, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x, norm2 = _arrays(batch, top.space)
                home = batch.column("cell").to_numpy(zero_copy_only=False)
                if own:
                    left = home[:, None] == np.arange(len(top.points))
                else:
                    lo, hi = _windows(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), top.space.m2)
                    inner = top.space.radius(norm2[:, None], hi)
                    outer = np.where(lo <= hi, top.space.radius(norm2[:, None], lo), -np.inf)
                    left = survivors(top.space.from_anchor(x, norm2, top.points), top.lo, top.hi, inner, outer, top.space.slack)
                    left[np.arange(len(home)), home] = False
                left &= top.shards > 0
                anchor, cell = np.nonzero(left)
                times = top.shards[cell]
                anchor, cell = np.repeat(anchor, times), np.repeat(cell, times)
                chunk = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, int)
                taken = batch.take(pa.array(anchor))
                block = taken.column("qid").to_numpy(zero_copy_only=False) % blocks
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell, pa.int32()), pa.array(chunk, pa.int32()), pa.array(block, pa.int32())],
                    names=[*taken.schema.names, "to_cell", "chunk", "block"])
    return run


def _search_shard(space: Space, same: bool, k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        x, norm2 = _arrays(rows, space)
        tree = Tree(space, rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), x, norm2)
        qx, q_norm2 = _arrays(asked, space)
        lo, hi = _windows(asked.column("lo").to_pylist(), asked.column("hi").to_pylist(), space.m2)
        block = Block(space, asked.column("anchor_id").to_numpy(), asked.column("label").to_numpy(), qx, q_norm2, lo, hi, same, k)
        tree.search(block)
        anchor, window, nth = np.nonzero(block.found != NO_ID)
        tags = asked.column("tags").to_pylist()
        return pa.table({
            "qid": pa.array(asked.column("qid").to_numpy()[anchor], pa.int64()),
            "tag": pa.array([tags[a][w] for a, w in zip(anchor, window)], pa.int64()),
            "cand_id": pa.array(block.found[anchor, window, nth], pa.int64()),
            "score": pa.array(block.score[anchor, window, nth], pa.int64())})
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k of each (qid, tag), numbered; every task keeps its own k before the shuffle."""
    order = Window.partitionBy("qid", "tag").orderBy(F.desc("score"), "cand_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def search(placed: DataFrame, top: Top, queries: DataFrame, n_queries: int, same: bool, k: int) -> DataFrame:
    """(qid, tag, cand_id, score, nth): the first k rows of each window of `queries` (saved; columns of QUERY)."""
    blocks = max(1, -(-n_queries // BLOCK_ANCHORS))

    def step(asked: DataFrame, own: bool) -> DataFrame:
        routed = saved(asked.mapInArrow(_route(top, own, blocks), ROUTED), "hardneg-routed")
        keys = ["cell", "chunk", "block"]
        anchors = routed.drop("cell").withColumnRenamed("to_cell", "cell")
        rows = placed.join(anchors.select(*keys).distinct(), ["cell", "chunk"])
        rows = rows.select("vec_id", "label", "x", "norm2", *[F.col(c).alias(f"in_{c}") for c in keys])
        return saved(rows.groupBy(*[f"in_{c}" for c in keys]).cogroup(anchors.groupBy(*keys)).applyInArrow(
            _search_shard(top.space, same, k), FOUND), "hardneg-found")

    first = step(queries, True)
    kth = _best(first, k).where(F.col("nth") == k).groupBy("qid").agg(
        F.map_from_entries(F.collect_list(F.struct("tag", "score"))).alias("kth"))
    raised = F.transform("tags", lambda t, i: F.greatest(F.element_at("lo", i + 1), F.coalesce(F.try_element_at("kth", t), F.element_at("lo", i + 1))))
    narrowed = queries.join(kth, "qid", "left").withColumn("lo", raised).select(*queries.columns)
    return _best(first.unionByName(step(narrowed, False)), k)


def mine(vectors: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = usable_rows(vectors)
    top = fit_top(rows)
    if top is None:
        return spark.createDataFrame([], OUTPUT)
    placed = saved(rows.where(F.size("x") == top.space.d).mapInArrow(_place(top), f"{ROWS}, cell int, chunk int"), "hardneg-placed")
    anchors = saved(placed.where(F.col("vec_id") % ANCHOR_EVERY == 0).select(
        F.monotonically_increasing_id().alias("qid"), F.col("vec_id").alias("anchor_id"), "label", "x", "norm2", "cell"), "hardneg-anchors")
    n = anchors.count()
    anywhere = anchors.selectExpr("*", "array(0L) AS tags", f"array(-{MAX_NORM2}L) AS lo", f"array({MAX_NORM2}L) AS hi")
    positives = saved(
        search(placed, top, anywhere, n, True, POSITIVES).select("qid", F.col("cand_id").alias("positive_id"),
                                                                 F.col("score").alias("positive_score")), "hardneg-positives")
    # one window for each different score, in integers: from ceil(p * 30 / 100) to floor(p * 90 / 100)
    low = F.expr(f"(positive_score DIV 100) * {LOW} + CAST(ceil(positive_score % 100 * {LOW} / 100) AS BIGINT)")
    high = F.expr(f"(positive_score DIV 100) * {HIGH} + CAST(floor(positive_score % 100 * {HIGH} / 100) AS BIGINT)")
    spans = positives.where("positive_score >= 0").select("qid", "positive_score", low.alias("l"), high.alias("h")).distinct()
    windows = spans.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("positive_score", "l", "h"))).alias("w"))
    asked = saved(anchors.join(windows, "qid").select(
        *anchors.columns, F.col("w.positive_score").alias("tags"), F.col("w.l").alias("lo"), F.col("w.h").alias("hi")), "hardneg-queries")
    negatives = search(placed, top, asked, n, False, NEGATIVES).withColumnsRenamed({"tag": "positive_score", "score": "negative_score"})
    return (positives.join(negatives, ["qid", "positive_score"]).join(anchors.select("qid", "anchor_id"), "qid")
            .select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("cand_id").alias("negative_id"),
                    "positive_score", "negative_score"))


#: Brute force over all pairs of anchors and rows.
ORACLE_SQL = f"""
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
           [CAST(floor(256 * CAST(c AS DOUBLE)) AS DOUBLE) FOR c IN embedding] AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score,
           ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS nth
    FROM s WHERE same),
n AS (
    SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score,
           ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    WHERE p.nth <= {POSITIVES} AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= {NEGATIVES}
"""
