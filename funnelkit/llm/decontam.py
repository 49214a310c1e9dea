"""Operator 9: benchmark decontamination by SimHash over item-sized windows.

Texts are lower-cased and cut into words (runs of letters, digits, `_`). An
item of n words is looked for in every window of n words of every document; a
document of fewer words is one window, over its own length:

1. *Windows.* A window with no shingle in common with an item has similarity 0,
   so windows are taken only where one of the item's shingles stands, at every
   offset that covers it. Each gets a 64-bit SimHash of its five-word shingles.
2. *Multi-index Hamming blocks.* Eight blocks of eight bits: two fingerprints
   within `RADIUS` bits differ by at most RADIUS // 8 bits in some block, so a
   table of 256 entries a block names every item within the radius; their full
   Hamming distance is checked then.
3. *Verification.* Weighted Jaccard similarity of the two multisets of shingles,
   a shingle weighing its idf over the whole benchmark, at least `SIMILARITY`.
   Weights are whole numbers, so sums do not depend on their order.

Items of under five words have one shingle, the whole item.

The benchmark goes to the tasks in blocks of bounded size (`BLOCK_ITEMS` items,
`BLOCK_CHARS` characters), one after the other, so the driver holds one block; a
larger benchmark makes more passes. With one block documents are only mapped.
With more, a block knows the idf of its own items' shingles; a window that may
reach `SIMILARITY` whatever its other shingles weigh goes on with those, and Spark
joins them to the table of all weights. Either way the similarity is the same.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm.common import join_by_group, saved, text_batches, texts_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
BLOCK_ITEMS, BLOCK_CHARS = 2000, 4_000_000
WEIGHT_ONE = 1 << 32

_WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of `size` words."""
    n = len(word_hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h * _P) ^ word_hashes[k:k + n]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash (a bit is 1 if set in over half) of every run of `size` shingle hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    counts = sums[size:] - sums[:-size]
    return np.packbits(2 * counts > size, axis=1, bitorder="little").view(np.uint64).reshape(-1)


class WordHashes:
    """XXH64 of words, remembered up to a bound."""

    def __init__(self, limit: int = 1_000_000) -> None:
        self.limit, self.of = limit, {}

    def __call__(self, found: list[str]) -> np.ndarray:
        new = set(found).difference(self.of)
        if new:
            if len(self.of) + len(new) > self.limit:
                self.of, new = {}, set(found)
            self.of.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
        return np.fromiter(map(self.of.__getitem__, found), np.uint64, len(found))


def weight(n: int, df: int) -> int:
    """idf of a shingle that stands in `df` of `n` items, as a whole number."""
    return round(math.log(1 + n / max(1, df)) * WEIGHT_ONE)


class Index:
    """One block of benchmark items: shingle postings, block tables, weights.

    `common` holds the weights of shingles of two items or more: of the whole
    benchmark (`whole`), or of the shingles of this block's items.
    """

    def __init__(self, items: list[tuple[int, str]], common: dict[int, int], n: int, whole: bool = True, radius: int = RADIUS) -> None:
        hashes = WordHashes()
        self.radius, self.common, self.whole = radius, common, whole
        self.unseen, self.least = weight(n, 1), weight(n, n)
        self.ids, self.lengths, self.counts, fps = [], [], [], []
        self.owners: dict[int, list[int]] = defaultdict(list)
        for item, text in items:
            found = words(text)
            if not found:
                continue
            sh = shingle_hashes(hashes(found), min(SHINGLE, len(found)))
            i = len(self.ids)
            self.ids.append(item)
            self.lengths.append(len(found))
            self.counts.append(Counter(sh.tolist()))
            fps.append(window_fingerprints(sh, len(sh))[0])
            for s in set(sh.tolist()):
                self.owners[s].append(i)
        self.lengths = np.array(self.lengths, np.int64)
        self.fps = np.array(fps, np.uint64)
        self.sizes = sorted({min(SHINGLE, n) for n in self.lengths.tolist()})
        self.filter = np.zeros(1 << _TABLE_BITS, bool)
        self.filter[[s >> (64 - _TABLE_BITS) for s in self.owners]] = True
        near = np.array([[(a ^ b).bit_count() for b in range(256)] for a in range(256)]) <= radius // BLOCKS
        item_blocks = self.fps.view(np.uint8).reshape(-1, BLOCKS)
        self.tables = [near[:, item_blocks[:, k]] for k in range(BLOCKS)]

    def candidates(self, fps: np.ndarray, length: int) -> list[tuple[int, int]]:
        """(window, item) pairs of that length within the radius, found through the block tables."""
        of_length = np.flatnonzero(self.lengths == length)
        parts = fps.view(np.uint8).reshape(-1, BLOCKS)
        hit = np.zeros((len(fps), len(of_length)), bool)
        for k, table in enumerate(self.tables):
            hit |= table[:, of_length][parts[:, k]]
        w, i = np.nonzero(hit)
        d = np.bitwise_count(fps[w] ^ self.fps[of_length[i]])
        ok = d <= self.radius
        return list(zip(w[ok].tolist(), of_length[i[ok]].tolist()))

    def overlap(self, window: Counter, item: int) -> tuple[int, int, list[int]] | None:
        """(shared weight, weight of both as far as known, shingles of unknown weight); None if below `SIMILARITY` in any case."""
        other, both, either, unknown = self.counts[item], 0, 0, []
        for s in window.keys() | other.keys():
            a, b = window.get(s, 0), other.get(s, 0)
            if not (self.whole or s in self.owners):
                unknown += [s] * a
                continue
            w = self.common.get(s, self.unseen)
            both += w * min(a, b)
            either += w * max(a, b)
        return (both, either, unknown) if both and both / (either + self.least * len(unknown)) >= SIMILARITY else None

    def windows(self, word_hashes: np.ndarray) -> Iterator[tuple[int, int, int, int, int, list[int]]]:
        """(item index, first word, end word, *overlap) of all windows that may reach `SIMILARITY`."""
        for size in self.sizes:
            sh = shingle_hashes(word_hashes, size)
            at = np.flatnonzero(self.filter[(sh >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            starts: dict[int, set[int]] = defaultdict(set)
            for p in at.tolist():
                for i in self.owners.get(int(sh[p]), ()):
                    n = int(self.lengths[i])
                    if min(SHINGLE, n) == size:
                        span = n - size + 1
                        starts[n].update(range(max(0, p - span + 1), max(0, min(p, len(sh) - span)) + 1))
            for n, wanted in starts.items():
                yield from self._verify(sh, min(n - size + 1, len(sh)), n, np.array(sorted(wanted), np.int64))

    def _verify(self, sh: np.ndarray, span: int, n: int, wanted: np.ndarray) -> Iterator[tuple]:
        for part in np.split(wanted, np.flatnonzero(np.diff(wanted) > span) + 1):
            for at in range(0, len(part), 4096):
                some = part[at:at + 4096]
                lo = int(some[0])
                fps = window_fingerprints(np.ascontiguousarray(sh[lo:int(some[-1]) + span]), span)[some - lo]
                last, seen = -1, Counter()
                for w, i in self.candidates(np.ascontiguousarray(fps), n):
                    start = int(some[w])
                    if w != last:
                        last, seen = w, Counter(sh[start:start + span].tolist())
                    found = self.overlap(seen, i)
                    if found:
                        yield (i, start, start + span + min(SHINGLE, n) - 1, *found)

    def matches(self, word_hashes: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Item index -> (best similarity, first word, end word); the first of equal windows. For a `whole` index."""
        best: dict[int, tuple[float, int, int]] = {}
        for i, start, end, both, either, _ in self.windows(word_hashes):
            if i not in best or both / either > best[i][0]:
                best[i] = (both / either, start, end)
        return best


def _idf(benchmark: DataFrame) -> DataFrame:
    """(shingle, df) over the whole benchmark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in text_batches(batches):
            out = []
            for t in texts_of(batch):
                found = words(t)
                if found:
                    out += set(shingle_hashes(hashes(found), min(SHINGLE, len(found))).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["s"])
    return benchmark.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("df"))


def _weights(df: DataFrame, n: int) -> DataFrame:
    """(s, weight) of the shingles of two items or more; all others weigh as unseen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [weight(n, k) for k in batch.column("df").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(w, pa.int64())], ["s", "weight"])
    return df.where("df > 1").mapInArrow(run, "s long, weight long")


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[Index, DataFrame]]:
    """The benchmark as indexes of bounded size, one after the other, each with the table of all weights.

    Items without id or without words match nothing; repeated items give the
    item id once.
    """
    rows = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
            .where("item_id is not null and text is not null").distinct())
    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not n:
        return
    blocks = max(1, math.ceil(n / BLOCK_ITEMS), math.ceil(chars / BLOCK_CHARS))
    if blocks > 1:
        rows = saved(rows, "benchmark")
    table = saved(_weights(_idf(rows), n), "benchmark-weights")
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        items = [(r.item_id, r.text) for r in block.orderBy("item_id", "text").toLocalIterator()]
        own = table if blocks == 1 else table.join(_idf(block).select("s"), "s", "left_semi")
        common = {r.s & 0xFFFFFFFFFFFFFFFF: r.weight for r in own.toLocalIterator()}
        if items:
            yield Index(items, common, n, blocks == 1), table


FOUND = "key string, item_id long, similarity double, start long, end long"


def _finder(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in text_batches(batches):
            keys, out = batch.column("key").to_pylist(), [[] for _ in range(5)]
            for key, text in zip(keys, texts_of(batch)):
                for i, (s, a, b) in index.matches(hashes(words(text))).items():
                    for col, v in zip(out, (key, index.ids[i], s, a, b)):
                        col.append(v)
            types = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], ["key", "item_id", "similarity", "start", "end"])
    return run


OPEN = "key string, item_id long, start long, end long, both long, either long, unknown array<long>"


def _opener(index: Index):
    """Windows that may match, in batches of at most 2000, so that a document with many holds few at a time."""
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 7
        types = (pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()))
        names = ["key", "item_id", "start", "end", "both", "either", "unknown"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows = WordHashes(), []
        for batch in text_batches(batches):
            for key, text in zip(batch.column("key").to_pylist(), texts_of(batch)):
                for i, start, end, both, either, unknown in index.windows(hashes(words(text))):
                    signed = np.array(unknown, np.uint64).view(np.int64).tolist()
                    rows.append((key, index.ids[i], start, end, both, either, signed))
                    if len(rows) >= 2000:
                        yield batch_of(rows)
                        rows = []
        yield batch_of(rows)
    return run


def _settled(windows: DataFrame, table: DataFrame, unseen: int) -> DataFrame:
    """Similarity of windows by the weights of their unknown shingles; those that reach `SIMILARITY`."""
    windows = saved(windows.withColumn("at", F.monotonically_increasing_id()), "benchmark-windows")
    each = windows.select("at", F.explode("unknown").alias("s"))
    known = saved(each.groupBy("s").agg(F.count(F.lit(1)).alias("rows")).join(table, "s", "left")
                  .withColumn("weight", F.coalesce("weight", F.lit(unseen))), "benchmark-known")
    extra = join_by_group(each, known, ["s"], "rows").groupBy("at").agg(F.sum("weight").alias("extra"))
    whole = F.col("either") + F.coalesce("extra", F.lit(0))
    out = windows.join(extra, "at", "left").withColumn("similarity", F.col("both") / whole).where(F.col("similarity") >= SIMILARITY)
    best = F.max_by(F.struct("similarity", "start", "end"), F.struct("similarity", -F.col("start")))
    return out.groupBy("key", "item_id").agg(best.alias("best")).select("key", "item_id", "best.*")


def _found(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`FOUND` over rows (key, text): the best window of each item in each row, or in each key if the benchmark has several blocks."""
    parts = []
    for index, table in item_blocks(benchmark):
        if index.whole:
            return rows.mapInArrow(_finder(index), FOUND)
        parts.append(saved(_settled(rows.mapInArrow(_opener(index), OPEN), table, index.unseen), "benchmark-found"))
    out = rows.sparkSession.createDataFrame([], FOUND)
    for part in parts:
        out = out.union(part)
    return out


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start, end): the best window of each item in each document, in words."""
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("key"), F.col("text").cast("string").alias("text"))
    return _found(rows, benchmark).select(F.col("key").cast("long").alias("doc_id"), "item_id", "similarity", "start", "end")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no benchmark item was found, all columns as they are.

    Null and empty texts stay; rows that repeat are judged alike; an empty
    benchmark keeps every row. A benchmark of several blocks names the
    contaminated texts by their SHA-256, and their rows go by an anti-join.
    """
    first = next(item_blocks(benchmark), None)
    if first is None:
        return docs
    if first[0].whole:
        return docs.mapInArrow(_cleaner(first[0]), docs.schema)
    digest = F.sha2(F.col("text").cast("string"), 256)
    rows = docs.select(digest.alias("key"), F.col("text").cast("string").alias("text")).where("key is not null")
    gone = saved(_found(rows, benchmark).select(F.col("key").alias("__leaked_text")).distinct(), "benchmark-leaks")
    return docs.join(gone, digest == gone["__leaked_text"], "left_anti")


def _cleaner(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in text_batches(batches):
            clean = [next(index.windows(hashes(words(t))), None) is None for t in texts_of(batch)]
            yield batch.filter(pa.array(clean, pa.bool_()))
    return run


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a contaminated doc_id: n_items, items (ids ascending, comma-joined), best_similarity.

    Documents without an item have no row. Rows that share a doc_id are one
    document and join their items, also the rows without one; null and empty
    texts are clean; an empty table gives an empty result. Equal similarities
    keep the first window.
    """
    found = find_items(docs, benchmark).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("found"), F.max("similarity").alias("best_similarity"))
    return found.select("doc_id", F.size("found").cast("long").alias("n_items"),
                        F.array_join(F.transform("found", lambda x: x.cast("string")), ",").alias("items"),
                        "best_similarity")


def read_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
