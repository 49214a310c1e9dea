"""Operator 6: toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the stems of a text's lower-cased words, their first `STEM` letters (an
insult's stem stays the same under its endings), known by 64-bit hashes. Texts
are unit vectors over all their terms: count x log(1 + n / df) x label factor. df
is over every document, counted by Spark for all terms of the examples; a term
that no example holds weighs as one of a single document (it only lengthens a
vector, which changes no rank). The label factor, sqrt(1 + log-likelihood ratio /
`RATIO`) over the examples, lets terms whose presence depends on the label speak
louder and silences none: without it, by plain TF-IDF, a few insults drown in the
prose around them (see the README for figures).

The examples form a block-max inverted index: a term's postings are cut into
blocks of `BLOCK` examples, each with the largest weight in it. A query adds up
query weight x block maximum for an upper bound a block, visits blocks from the
largest bound on, scores their examples exactly and stops once no bound can
beat the k-th best: the k nearest are exact.

Copies among the examples would pass for evidence, so of the sample's texts
within `COPY_BITS` SimHash bits of each other only the first is an example, and
none if their labels differ. Votes are weighted by similarity (1 - distance)
against a prior of base-rate votes. k and a Platt curve are chosen on the sample
itself, each example scored without itself and both labels counting alike: a
score is the probability of label 1 at even odds. A text that shares no term with
any example (an empty one) has no neighbour and is scored by the rate of label 1.

Texts are worked on in batches: Arrow numbers the different stems, numpy counts
(document, term) pairs by sorting. Nothing but the sample's texts and arrays over
its terms reaches the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.common import fold, sample_by_hash, text_batches, texts_of
from funnelkit.llm.simhash import majority, shingle_hashes

HELD_OUT_FOLDS, HELD_OUT = 3, 1
SAMPLE_ROWS = 1500        # a label; the sample's bound
SAMPLE_CHARS = 200_000    # longer labelled texts are not examples (all texts are scored whole)
STEM = 4
RATIO = 25.0              # log-likelihood ratio that adds 1 to the square of a term's label factor
BLOCK = 64
FIRST_BLOCKS = 8          # blocks scored before the bounds are compared with the k-th best
FREQUENT = 0.1            # terms of a larger part of the examples stand in a matrix
QUERIES = 256             # texts whose products are taken together
NEIGHBOURS = (10, 15, 20, 40)  # k is the one with the least log loss on the sample
PRIOR_VOTES = 0.1
COPY_BITS = 3
THRESHOLD = 0.7
BATCH_CHARS = 4_000_000   # of texts worked on at a time

_STEM = re.compile(rf"([^\W_]{{1,{STEM}}})[^\W_]*")


# ------------------------------------------------------------- terms of many texts

def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term hash, count) of every term of whole texts, by text."""
    found = [_STEM.findall(t.lower()) for t in texts]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    flat = pa.array([w for words in found for w in words], pa.large_string()).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    n = max(1, len(hashes))
    keys, counts = np.unique(np.repeat(np.arange(len(texts)), lengths) * n + flat.indices.to_numpy(), return_counts=True)
    return keys // n, hashes[keys % n], counts


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Slices of the texts of about `BATCH_CHARS` characters, with the number of the first."""
    at = 0
    while at < len(texts):
        start, chars = at, 0
        while at < len(texts) and (at == start or chars + len(texts[at]) <= BATCH_CHARS):
            chars += len(texts[at])
            at += 1
        yield start, texts[start:at]


class Weights:
    """Hashes of the examples' terms (ascending) and the idf of each; any other term has `unseen`."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, unseen: float) -> None:
        self.terms, self.idf, self.unseen = terms, idf, unseen

    def columns(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of terms, -1 for others."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(columns ascending, weights) of each text's unit vector; terms that no example holds only lengthen it."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for _, part in _pieces(texts):
            doc, hashes, counts = term_counts(part)
            column = self.columns(hashes)
            w = counts * np.where(column >= 0, self.idf[column] if len(self.idf) else 0.0, self.unseen)
            norm = np.sqrt(np.bincount(doc, w * w, len(part)))
            held = column >= 0
            doc, column, w = doc[held], column[held], w[held] / norm[doc[held]]
            order = np.lexsort((column, doc))
            doc, column, w = doc[order], column[order], w[order]
            ends = np.searchsorted(doc, np.arange(len(part) + 1))
            out += [(column[a:b], w[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return out


# ------------------------------------------------------------- the index

class Index:
    """Block-max inverted index over labelled unit vectors (columns ascending, weights).

    Terms of over a `FREQUENT` part of the examples would list nearly all of them
    in every block: their weights stand as rows of a matrix, and one product gives
    their exact part of all similarities of many queries. The other terms have
    postings in blocks with their largest weights, which bound what is still open.
    """

    def __init__(self, n_terms: int, vectors: list, ids: list, labels: list[int]) -> None:
        self.ids, self.labels = ids, np.array(labels, np.float64)
        self.blocks = max(1, -(-len(vectors) // BLOCK))
        at = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in vectors)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        example = np.repeat(np.arange(len(vectors)), [len(c) for c, _ in vectors]) if vectors else np.zeros(0, np.int64)
        often = np.bincount(at, minlength=n_terms) > FREQUENT * len(vectors)
        self.row = np.where(often, np.cumsum(often) - 1, -1)  # of a frequent term in the matrix
        self.matrix = np.zeros((int(often.sum()), len(vectors)))
        self.matrix[self.row[at[often[at]]], example[often[at]]] = weight[often[at]]
        at, weight, example = (x[~often[at]] for x in (at, weight, example))
        order = np.lexsort((example, at))
        self.example = example[order].astype(np.int32)
        self.weight = weight[order]
        cell = at[order] * self.blocks + self.example // BLOCK
        self.cells, starts = np.unique(cell, return_index=True)  # the (term, block) pairs that hold postings
        self.starts = np.append(starts, len(cell))
        self.maxima = np.maximum.reduceat(self.weight, starts) if len(starts) else np.zeros(0)
        self.of_term = np.searchsorted(self.cells, np.arange(n_terms + 1) * self.blocks)
        self.block_of = np.arange(len(vectors)) // BLOCK

    def nearest(self, vector: tuple[np.ndarray, np.ndarray], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k most similar examples (similarity, example), ties to the smaller example; none of similarity 0."""
        return self.nearest_of([vector], k, [skip])[0]

    def nearest_of(self, vectors: list, k: int, skips: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """`nearest` of many vectors; skips: an example each that does not count, -1 for none."""
        if not self.ids:
            return [[] for _ in vectors]
        out, edges = [], np.arange(0, len(self.ids), BLOCK)
        for start in range(0, len(vectors), QUERIES):
            part = vectors[start:start + QUERIES]
            queries = np.zeros((len(part), len(self.matrix)))
            for i, (cols, weights) in enumerate(part):
                row = self.row[cols]
                queries[i, row[row >= 0]] = weights[row >= 0]
            exact = queries @ self.matrix
            most = np.maximum.reduceat(exact, edges, axis=1)
            out += [self._finish(v, exact[i], most[i], k, skips[start + i] if skips else -1) for i, v in enumerate(part)]
        return out

    def _finish(self, vector, exact: np.ndarray, most: np.ndarray, k: int, skip: int) -> list[tuple[float, int]]:
        """Adds the postings' part to one query's frequent part, block by block from the largest bound on."""
        cols, weights = vector
        rare = self.row[cols] < 0
        cell, q = _ranges(self.of_term[cols[rare]], self.of_term[cols[rare] + 1], weights[rare])
        block = self.cells[cell] % self.blocks if len(cell) else cell
        bounds = most + np.bincount(block, q * self.maxima[cell] if len(cell) else None, self.blocks)
        order = np.argsort(-bounds, kind="stable")
        first = max(FIRST_BLOCKS, -(-2 * k // BLOCK))
        best: list[tuple[float, int]] = []
        for part in (order[:first], order[first:]):
            least = best[-1][0] - 1e-9 if len(best) == k else 0.0
            wanted = np.zeros(self.blocks, bool)
            wanted[part] = (bounds[part] > 0) & (bounds[part] >= least)
            if not wanted.any():
                continue
            use = wanted[block]
            post, w = _ranges(self.starts[cell[use]], self.starts[cell[use] + 1], q[use])
            scores = (exact + np.bincount(self.example[post], w * self.weight[post], len(self.ids))) * wanted[self.block_of]
            if skip >= 0:
                scores[skip] = 0
            top = np.flatnonzero(scores >= max(least, 1e-12))
            if len(top) > k:
                top = top[scores[top] >= np.partition(scores[top], -k)[-k] - 1e-9]
            best = sorted([*best, *zip(scores[top].round(12).tolist(), top.tolist())], key=lambda x: (-x[0], x[1]))[:k]
        return best


def _ranges(lo: np.ndarray, hi: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges lo..hi one after the other, and each one's weight."""
    n = hi - lo
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + n, n)
    return at, np.repeat(weights, n)


class Model:
    """Weights, index, k, base rates and the calibration of the vote share."""

    def __init__(self, weights: Weights, index: Index, k: int, base: float, rate: float, a: float, b: float) -> None:
        self.weights, self.index, self.k, self.base, self.rate, self.a, self.b = weights, index, k, base, rate, a, b

    def share(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the votes, with a prior of the sample's base rate."""
        votes = sum(s for s, _ in near)
        return (sum(s * self.index.labels[i] for s, i in near) + PRIOR_VOTES * self.base) / (votes + PRIOR_VOTES)

    def score(self, vectors: list) -> list[tuple[float, list[tuple[float, int]]]]:
        """(score, neighbours) of texts' vectors."""
        return [(float(_sigmoid(self.a * self.share(near) + self.b)) if near else self.rate, near)
                for near in self.index.nearest_of(vectors, self.k)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def balanced(labels: np.ndarray) -> np.ndarray:
    """A weight a row, so that both labels weigh as much together."""
    n1 = labels.sum()
    return len(labels) * np.where(labels == 1, 0.5 / max(1.0, n1), 0.5 / max(1.0, len(labels) - n1))


def platt(shares: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and offset of a balanced logistic fit with smoothed targets, by Newton steps with a ridge."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    y, each = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), balanced(labels)
    x, w = np.stack([shares, np.ones_like(shares)], 1), np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (each * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (each * (y - p)) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def without_copies(rows: list[tuple[int | None, str, int]]) -> list[tuple[int | None, str, int]]:
    """One row, the first by doc_id, of those within `COPY_BITS` of each other; none where their labels differ."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    fps = majority([shingle_hashes(t) for _, t, _ in rows])
    kept, mixed = [], set()
    for i in range(len(rows)):
        near = [kept[j] for j in np.flatnonzero(np.bitwise_count(fps[kept] ^ fps[i]) <= COPY_BITS)] if kept else []
        if not near:
            kept.append(i)
        mixed.update(j for j in near if rows[j][2] != rows[i][2])
    return [rows[i] for i in kept if i not in mixed]


def label_factors(terms: np.ndarray, texts: list[str], labels: list[int]) -> np.ndarray:
    """Of each term: 1 if its presence says nothing about the label, more the more it does."""
    known, y = Weights(terms, np.zeros(len(terms)), 0.0), np.array(labels, np.float64)
    n, n1 = float(len(labels)), float(sum(labels))
    holds, toxic = np.zeros(len(terms)), np.zeros(len(terms))
    for start, part in _pieces(texts):
        doc, hashes, _ = term_counts(part)
        column = known.columns(hashes)
        holds += np.bincount(column, minlength=len(terms))
        toxic += np.bincount(column, y[start + doc], minlength=len(terms))
    ratio = np.zeros(len(terms))
    for seen, due in ((toxic, holds * n1), (holds - toxic, holds * (n - n1)), (n1 - toxic, (n - holds) * n1),
                      (n - n1 - holds + toxic, (n - holds) * (n - n1))):
        some = seen > 0
        ratio[some] += 2 * seen[some] * np.log(seen[some] * n / due[some])
    return np.sqrt(1 + np.maximum(0.0, ratio) / RATIO)


def train(rows: list[tuple[int | None, str, int]], rate: float, count_df) -> Model:
    """From (doc_id, text, label) examples and the rate of label 1 among all labelled rows.

    `count_df` gives, for term hashes, the number of all documents and how many
    hold each term. Without examples no text has a neighbour and all score `rate`.
    """
    rows = without_copies(rows)
    texts = [t for _, t, _ in rows]
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(term_counts(part)[1] for _, part in _pieces(texts))]))
    n, df = count_df(terms)
    factors = label_factors(terms, texts, [y for *_, y in rows])
    weights = Weights(terms, factors * np.log1p(n / np.maximum(1, df)), math.log1p(n))
    vectors = weights.vectors(texts)
    # blocks of texts with the same heaviest common term have low bounds for the others
    lead = [int(c[np.argmax(df[c])]) if len(c) else -1 for c, _ in vectors]
    order = [i for i in sorted(range(len(rows)), key=lambda i: (lead[i], i)) if len(vectors[i][0])]
    index = Index(len(terms), [vectors[i] for i in order], [rows[i][0] for i in order], [rows[i][2] for i in order])
    base = sum(y for *_, y in rows) / len(rows) if rows else 0.0
    model = Model(weights, index, NEIGHBOURS[0], base, rate, 1.0, 0.0)
    if not order:
        return model
    nearest = index.nearest_of([vectors[i] for i in order], max(NEIGHBOURS), list(range(len(order))))
    fits = []
    for k in NEIGHBOURS:
        shares = np.array([model.share(near[:k]) for near in nearest])
        a, b = platt(shares, index.labels)
        p = _sigmoid(a * shares + b)
        loss = -np.log(np.where(index.labels == 1, p, 1 - p))
        fits.append((float(np.mean(balanced(index.labels) * loss)), k, a, b))
    _, model.k, model.a, model.b = min(fits)
    return model


# ------------------------------------------------------------- Spark side

def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of rows, rows that hold each term) over the whole table; a task sends one row a term it met."""
    known = Weights(terms, np.zeros(len(terms)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(known.terms), np.int64), 0
        for batch in text_batches(batches):
            rows += batch.num_rows
            for _, part in _pieces(texts_of(batch)):
                column = known.columns(term_counts(part)[1])
                df += np.bincount(column[column >= 0], minlength=len(df))
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(met, -1)), pa.array(np.append(df[met], rows))], ["term", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term long, n long")
    found = sums.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most the sample's terms
    at, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(len(terms), np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), df


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most `sample_rows` labelled rows a label outside the held-out fold, chosen by a hash of the id.

    Rows without a label or with a label other than 0 and 1 teach nothing; a
    doc_id that `labels` holds twice takes its largest label.
    """
    marks = (labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
             .where("toxic in (0, 1) and __id is not null").where(fold(F.col("__id"), HELD_OUT_FOLDS) != HELD_OUT)
             .groupBy("__id").agg(F.max("toxic").alias("toxic")))
    rate = marks.agg(F.avg("toxic").alias("rate")).first()["rate"] or 0.0
    chosen = F.broadcast(sample_by_hash(marks, F.col("__id"), ["toxic"], sample_rows, seed=6))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.join(chosen, F.col("doc_id") == F.col("__id")).where(F.length("text") <= SAMPLE_CHARS)
    sample = [(r.doc_id, r.text, r.toxic) for r in found.select("doc_id", "text", "toxic").collect()]
    return train(sample, float(rate), lambda terms: document_frequencies(rows, terms))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            scores, evidence = [], []
            for s, near in model.score(model.weights.vectors(texts_of(batch))):
                scores.append(s)
                evidence.append(",".join(f"{model.index.ids[i]}:{sim:.4f}:{int(model.index.labels[i])}" for sim, i in near[:5]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(evidence, pa.string())],
                ["doc_id", "held_out", "score", "predicted", "evidence"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row, read as a whole text.

    evidence: the five nearest examples as doc_id:similarity:label. Null and
    empty texts score as texts without a term. Repeated rows give repeated
    rows; a null doc_id stays null and counts as empty text in the fold; an
    empty table gives an empty result; extra columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (fold(F.col("doc_id"), HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double, predicted int, evidence string")
