"""Operator 8: SimHash near-duplicates linked through BK-trees.

A fingerprint has 64 bits, one for each bit position that is set in over half
of the document's shingle hashes. Fingerprints within `radius` differing bits
are linked; linked documents form components.

Search. Equal fingerprints collapse first (copies cost one row a task). Of
`radius + 1` disjoint blocks of bits, two fingerprints within the radius share
at least one whole block, so (block, value) names a *shard* and each linked
pair meets in a shard. A shard with more than `shard_limit` fingerprints is
split again by blocks of its remaining bits (same pigeonhole), up to three
times; after that a shard can hold no more than 2**20 different fingerprints.
Each shard's fingerprints are put into a BK-tree whose children are keyed by
the integer Hamming distance to their parent; a query follows only the edges
within distance +- radius. Trees are shipped to the tasks by the shuffle, not by
a driver broadcast: together they hold every fingerprint of the corpus, which
has no size bound. A shard emits a spanning forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.common import saved, text_batches, texts_of
from funnelkit.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 2
SHARD_LIMIT = 4096

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 of every word shingle, repeats included; fewer words: of the whole sequence; none: empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    cut = map(slice, [0, *ends[:-size]], [e - 1 for e in ends[size - 1:]])
    return list(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cut), repeat(SEED)))


def majority(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint (uint64) of each list; an empty list gives zero.

    Bits are added in byte lanes over runs of at most 255 hashes, then over a
    document's runs, so no document needs a 64-column table of bits.
    """
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([np.array(hashes[i], np.uint64) for i in full])
    starts = np.cumsum(sizes[full]) - sizes[full]
    runs = -(-sizes[full] // 255)
    first = np.cumsum(runs) - runs
    at = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    half = sizes[full]
    for shift in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(shift)) & _LANES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > half).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def _fingerprint(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            fp = majority([shingle_hashes(t, size) for t in texts_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for every row and whole text; a null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint(size), "doc_id long, fp long")


class BKTree:
    """Burkhard-Keller tree over 64-bit ints: children keyed by Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, fp: int) -> None:
        """Hang `fp` below the nearest free edge; a member already present stays as it is."""
        if self.root is None:
            self.root = (fp, {})
            return
        value, children = self.root
        while d := (value ^ fp).bit_count():
            if d not in children:
                children[d] = (fp, {})
                return
            value, children = children[d]

    def near(self, fp: int, radius: int) -> list[int]:
        """Members within `radius` of `fp`: only edges d - radius to d + radius are followed."""
        found, todo = [], [] if self.root is None else [self.root]
        while todo:
            value, children = todo.pop()
            d = (value ^ fp).bit_count()
            if d <= radius:
                found.append(value)
            if children:
                todo.extend(children[e] for e in range(d - radius, d + radius + 1) if e in children)
        return found


def forest(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (member, root) of a spanning forest over all members within `radius` of each other."""
    tree, parent = BKTree(), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for fp in members:
        if fp in parent:
            continue
        parent[fp] = fp
        near = tree.near(fp, radius)
        tree.add(fp)
        for other in near:
            a, b = root(fp), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _shard_links(radius: int):
    def flush(members: list[int], out: list[tuple[int, int]]) -> None:
        if len(members) > 1:
            out.extend(forest(members, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(keys)]
            out: list[tuple[int, int]] = []
            if key is not None and keys[0] != key:
                flush(members, out)
                members = []
            sizes = np.diff(bounds)
            for i, n in enumerate(sizes.tolist()):
                if i == 0 or n > 1 or i == len(sizes) - 1:
                    part = fps[bounds[i]:bounds[i + 1]].tolist()
                    members = members + part if i == 0 else part
                    if i < len(sizes) - 1:
                        flush(members, out)
                        members = []
            key = keys[-1]
            yield _links(out)
        out = []
        flush(members, out)
        yield _links(out)
    return run


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    cols = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(cols[:, 0]), pa.array(cols[:, 1])], ["u", "v"])


def _blocks(width: int, n: int) -> list[tuple[int, int]]:
    """(offset, size) of n blocks that cover `width` bits."""
    sizes = [width // n + (i < width % n) for i in range(n)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def _split(rows: DataFrame, width: int, n: int) -> DataFrame:
    """Each row (fp, key, rest) once for each block of `rest`: the block joins the key and leaves the rest."""
    parts = []
    for i, (lo, size) in enumerate(_blocks(width, n)):
        block = F.shiftrightunsigned("rest", lo).bitwiseAND(F.lit((1 << size) - 1))
        above = F.shiftleft(F.shiftrightunsigned("rest", lo + size), lo) if lo + size < 64 else F.lit(0).cast("long")
        rest = F.col("rest").bitwiseAND(F.lit((1 << lo) - 1)).bitwiseOR(above)
        tag = F.shiftleft(F.shiftleft("key", 2).bitwiseOR(F.lit(i).cast("long")), size).bitwiseOR(block)
        parts.append(F.struct(tag.alias("key"), rest.alias("rest")))
    one = rows.select("fp", F.explode(F.array(*parts)).alias("p"))
    return one.select("fp", F.col("p.key").alias("key"), F.col("p.rest").alias("rest"))


def shards(fps: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(key, fp): every pair within `radius` shares a key; see the module's text for the bound on a shard."""
    n = radius + 1
    rows = fps.select("fp", F.lit(1).cast("long").alias("key"), F.col("fp").alias("rest"))
    width, done = 64, None
    for level in range(3):
        rows = _split(rows, width, n)
        width -= width // n
        crowded = saved(rows.groupBy("key").count().where(F.col("count") > shard_limit).select("key"), "simhash-crowded")
        last = level == 2 or crowded.isEmpty()
        keep = rows.select("key", "fp") if last else rows.join(crowded, "key", "left_anti").select("key", "fp")
        keep = keep.withColumn("key", F.shiftleft("key", 2).bitwiseOR(F.lit(level).cast("long")))  # keys may wrap: shards merge
        done = keep if done is None else done.union(keep)
        if last:
            return done
        rows = rows.join(crowded, "key", "left_semi").select("fp", "key", "rest")
    return done


def links(fps: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (u, v) whose components are those of all pairs within `radius`; fps holds different fingerprints."""
    if not 1 <= radius <= 3:
        raise ValueError("a radius of 1 to 3 bits keeps the shard keys within 64 bits")
    dealt = shards(fps, radius, shard_limit).repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_shard_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included.

    One row for each input row. A null or empty text has fingerprint zero and
    links like any other; very long texts are read whole. Rows that repeat give
    repeated rows; rows that share a doc_id link only through their
    fingerprints. Null doc_ids take the component of their fingerprint (null if
    no row of it has an id). An empty table gives an empty result; extra
    columns are not read.
    """
    marked = saved(fingerprints(docs, shingle), "simhash-docs")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("lead"))
    roots = components(links(classes.select("fp"), radius, shard_limit), "simhash-links")
    tied = roots.select(F.col("vertex").alias("fp"), "root").join(classes, "fp")
    lowest = tied.groupBy("root").agg(F.min("lead").alias("component_id"))
    linked = tied.join(lowest, "root").select("fp", "component_id")
    final = (classes.join(linked, "fp", "left")
             .select("fp", F.coalesce("component_id", "lead").alias("component_id")))
    return marked.join(final, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns, of one document a component: that with the smallest doc_id.

    A document is a (doc_id, fingerprint): rows that share an id but not the
    fingerprint are judged each by its own component, and rows that share both
    collapse to the one with the smallest text. Rows without a doc_id stay, as
    nothing names them.
    """
    found = near_duplicates(docs, **how)
    named = found.where("doc_id IS NOT NULL")
    again = saved(named.groupBy(F.col("doc_id").alias("__again_id")).count().where("count > 1").select("__again_id"), "simhash-again")
    lost = named.where("doc_id <> component_id").select(F.col("doc_id").alias("__lost_id")).distinct()
    if again.isEmpty():
        return docs.join(lost, docs["doc_id"] == lost["__lost_id"], "left_anti")
    gone = lost.union(again).distinct()
    once = docs.join(gone, docs["doc_id"] == gone["__lost_id"], "left_anti")
    # ids that several rows share: their fingerprints are taken again, row by row
    shared = docs.join(again, docs["doc_id"] == again["__again_id"], "left_semi")
    rows = saved(shared.select(F.monotonically_increasing_id().alias("__at"), F.col("doc_id").alias("__id"), F.col("text").alias("__text"),
                               F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")), "simhash-shared")
    marks = fingerprints(rows.select(F.col("__at").alias("doc_id"), F.col("__text").alias("text")), how.get("shingle", SHINGLE))
    stays = named.where("doc_id = component_id").select(F.col("doc_id").alias("__stay_id"), F.col("fp").alias("__stay_fp")).distinct()
    picked = (rows.join(marks.select(F.col("doc_id").alias("__mark"), "fp"), F.col("__at") == F.col("__mark"))
              .join(stays, (F.col("__id") == F.col("__stay_id")) & (F.col("fp") == F.col("__stay_fp")))
              .groupBy("__id", "fp").agg(F.min_by("__row", F.coalesce(F.col("__text"), F.lit(""))).alias("__row")))
    return once.union(picked.select("__row.*"))
