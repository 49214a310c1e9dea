"""Operator 10: language identification by a bidirectional gated recurrent network over bytes.

Texts are lower-cased and cut into runs of letters; every byte of every run is
a position. A forward and a backward GRU read each run's UTF-8 bytes, a softmax
labels each position, and a document's probabilities are the mean over all its
positions. Runs longer than `MAX_RUN` bytes are read in consecutive pieces, so
nothing of a text is left out; the state starts afresh with each run.

Since a run's sums depend on the run alone, each task computes them once for
each different run it meets (a table of bounded size, rebuilt when full).

Training: numpy, Adam, backpropagation through time in both directions, on a
bounded sample (`train_docs` documents a language, chosen by a hash of doc_id)
of the documents outside the held-out fold that have a language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.common import fold, kept, sample_by_hash, text_batches, texts_of

HELD_OUT_FOLDS, HELD_OUT = 4, 2
TRAIN_DOCS = 150          # a language; the sample's bound
TRAIN_RUNS = 3000         # different runs a language taken from the sample
MAX_RUN = 16              # bytes read with one state
HIDDEN = 12
STEPS, BATCH, RATE = 300, 192, 0.02
MIN_SCORE = 0.3           # below it no language leads; the pipeline's stage rejects such a document
CACHE_RUNS = 300_000
UNDETERMINED = "und"

_RUN = re.compile(r"[^\W\d_]+")


def runs(text: str) -> list[str]:
    """The text's runs of letters (Unicode categories L), lower-cased; `½` or `Ⅷ` is none."""
    found = _RUN.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for run in found for part in "".join(c if c.isalpha() else " " for c in run).split()]


def pieces(run: str) -> list[bytes]:
    data = run.encode("utf-8", "surrogatepass")
    return [data[i:i + MAX_RUN] for i in range(0, len(data), MAX_RUN)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Model:
    """Weights: for each direction the byte table (256, 3H) and recurrent matrices, then the output layer."""

    langs: list[str]
    weights: dict[str, np.ndarray]

    def position_probabilities(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(positions, texts, languages) for padded byte ids (positions, texts)."""
        f = _scan(self.weights, "f", ids, mask)[0]
        b = _scan(self.weights, "b", ids[::-1], mask[::-1])[0][::-1]
        logits = f @ self.weights["of"] + b @ self.weights["ob"] + self.weights["bias"]
        e = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def run_sums(self, texts: list[bytes]) -> np.ndarray:
        """For each piece the sum of its positions' probabilities, and the number of positions."""
        out = np.zeros((len(texts), len(self.langs) + 1), np.float32)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for at in range(0, len(order), 2048):
            part = order[at:at + 2048]
            ids, mask = padded([texts[i] for i in part])
            p = self.position_probabilities(ids, mask) * mask[:, :, None]
            out[part, :-1] = p.sum(axis=0)
            out[part, -1] = mask.sum(axis=0)
        return out


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte ids and mask, both (positions, texts)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    width = max(1, int(size.max()))
    mask = (np.arange(width)[:, None] < size[None, :])
    ids = np.zeros((len(texts), width), np.int64)
    ids[mask.T] = np.frombuffer(b"".join(texts), np.uint8)
    return ids.T.copy(), mask.astype(np.float32)


def _scan(w: dict, side: str, ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
    """One direction; masked positions keep the state. Returns states and what backpropagation needs."""
    table, uzr, un = w["x" + side], w["uzr" + side], w["un" + side]
    n = un.shape[0]
    h = np.zeros((ids.shape[1], n), np.float32)
    states, tape = np.empty((*ids.shape, n), np.float32), []
    for t in range(ids.shape[0]):
        x = table[ids[t]]
        gates = _sigmoid(x[:, :2 * n] + h @ uzr)
        z, r = gates[:, :n], gates[:, n:]
        rh = r * h
        c = np.tanh(x[:, 2 * n:] + rh @ un)
        zm = z * mask[t][:, None]
        tape.append((h, z, r, rh, c, zm))
        h = h + zm * (c - h)
        states[t] = h
    return states, tape


def _back(w: dict, side: str, ids: np.ndarray, mask: np.ndarray, tape: list, above: np.ndarray, g: dict) -> None:
    """Backpropagation through time: `above` is the loss gradient at each state."""
    uzr, un = w["uzr" + side], w["un" + side]
    n = un.shape[0]
    dh = np.zeros_like(above[0])
    table, guzr, gun = np.zeros_like(w["x" + side]), np.zeros_like(uzr), np.zeros_like(un)
    for t in range(ids.shape[0] - 1, -1, -1):
        h, z, r, rh, c, zm = tape[t]
        dh = dh + above[t]
        dc = dh * zm * (1 - c * c)
        dz = dh * (c - h) * mask[t][:, None] * z * (1 - z)
        drh = dc @ un.T
        dr = drh * h * r * (1 - r)
        dgates = np.concatenate([dz, dr], axis=1)
        gun += rh.T @ dc
        guzr += h.T @ dgates
        np.add.at(table, ids[t], np.concatenate([dgates, dc], axis=1))
        dh = dh * (1 - zm) + drh * r + dgates @ uzr.T
    g["x" + side], g["uzr" + side], g["un" + side] = table, guzr, gun


def gradients(model: Model, ids: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over positions and its gradients."""
    w = model.weights
    f, tape_f = _scan(w, "f", ids, mask)
    b, tape_b = _scan(w, "b", ids[::-1], mask[::-1])
    b_at = b[::-1]
    logits = f @ w["of"] + b_at @ w["ob"] + w["bias"]
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    p = e / e.sum(axis=-1, keepdims=True)
    total = mask.sum()
    right = p[:, np.arange(len(label)), label]
    loss = float(-(np.log(right + 1e-9) * mask).sum() / total)
    p[:, np.arange(len(label)), label] -= 1
    d = (p * (mask / total)[:, :, None]).astype(np.float32)
    flat = d.reshape(-1, d.shape[-1])
    g = {"of": f.reshape(-1, f.shape[-1]).T @ flat, "ob": b_at.reshape(-1, f.shape[-1]).T @ flat, "bias": flat.sum(0)}
    _back(w, "f", ids, mask, tape_f, d @ w["of"].T, g)
    _back(w, "b", ids[::-1], mask[::-1], tape_b, (d @ w["ob"].T)[::-1], g)
    return loss, g


def new_model(langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    w = {}
    for side in "fb":
        w |= {"x" + side: draw(256, 3 * hidden), "uzr" + side: draw(hidden, 2 * hidden), "un" + side: draw(hidden, hidden)}
    return Model(langs, w | {"of": draw(hidden, len(langs)), "ob": draw(hidden, len(langs)),
                             "bias": np.zeros(len(langs), np.float32)})


def train(examples: list[tuple[bytes, int]], langs: list[str], steps: int = STEPS, seed: int = 7) -> Model:
    """Adam over balanced batches of (piece, language index)."""
    model, rng = new_model(langs, seed=seed), np.random.default_rng(seed)
    by_lang = [[t for t, y in examples if y == k] for k in range(len(langs))]
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    v = {k: np.zeros_like(x) for k, x in model.weights.items()}
    for step in range(1, steps + 1):
        label = rng.integers(0, len(langs), BATCH)
        ids, mask = padded([by_lang[k][rng.integers(len(by_lang[k]))] for k in label])
        _, g = gradients(model, ids, mask, label)
        rate = RATE * (1 - step / (steps + 1)) + 1e-4
        for k, x in model.weights.items():
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
            x -= (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, steps: int = STEPS) -> Model | None:
    """Train on the sample; None if no document outside the held-out fold has a language and a letter."""
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"))
            .where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
            .where(fold(F.col("doc_id"), HELD_OUT_FOLDS) != HELD_OUT))
    key = F.concat_ws("/", F.col("doc_id").cast("string"), F.md5("text"))
    sample = sample_by_hash(rows.select("doc_id", "text", "lang"), key, ["lang"], train_docs, seed=10)
    words: dict[str, Counter] = {}
    for row in sample.select("lang", _sample_runs(F.col("text")).alias("runs")).toLocalIterator():
        words.setdefault(row.lang, Counter()).update(row.runs)
    langs = sorted(k for k, c in words.items() if c)
    if not langs:
        return None
    examples = []
    for k, lang in enumerate(langs):
        common = sorted(words[lang].items(), key=lambda x: (-x[1], x[0]))[:TRAIN_RUNS]
        for run, n in common:  # a run counts as often as the root of its frequency
            examples += [(p, k) for p in pieces(run) for _ in range(max(1, int(n ** 0.5)))]
    return train(examples, langs, steps)


def _sample_runs(text):
    """Runs of letters in the JVM, for the sample alone (at most `TRAIN_DOCS` texts a language)."""
    return F.expr("regexp_extract_all(lower(text), '\\\\p{L}+', 0)")


class _Reader:
    """Predicts documents, with the sums of the runs met so far."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.sums = np.zeros((0, len(self.model.langs) + 1), np.float32)

    def learn(self, new: list[str]) -> None:
        parts, owner = [], []
        for i, run in enumerate(new):
            p = pieces(run)
            parts += p
            owner += [i] * len(p)
        sums = np.zeros((len(new), self.sums.shape[1]), np.float32)
        np.add.at(sums, owner, self.model.run_sums(parts))
        first = len(self.at)
        self.at.update(zip(new, range(first, first + len(new))))
        self.sums = np.concatenate([self.sums, sums])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        found = [runs(t) for t in texts]
        fresh = {r for f in found for r in f}
        if len(self.at) + len(fresh) > CACHE_RUNS:
            self.clear()
        fresh = sorted(fresh.difference(self.at))
        if fresh:
            self.learn(fresh)
        langs, scores = [], []
        for f in found:
            if not f:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.sums[np.fromiter(map(self.at.__getitem__, f), np.int64, len(f))].sum(axis=0, dtype=np.float64)
            best = int(total[:-1].argmax())
            langs.append(self.model.langs[best])
            scores.append(min(1.0, float(total[best] / total[-1])))
        return langs, scores


def reader_of(model: Model | None) -> _Reader | None:
    """The worker process's reader of this model, kept from task to task; another model replaces it."""
    if model is None:
        return None
    key = b"".join(model.weights[k].tobytes() for k in sorted(model.weights))
    return kept(("language", key), lambda: _Reader(model))


def _predictor(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(model)
        for batch in text_batches(batches, 256):
            texts = texts_of(batch)
            lang, score = reader.predict(texts) if reader else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()),
                 pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, read as a whole text.

    Null or letterless texts (and all texts, if nothing could be learned) get
    `und` with score 0. Ties of languages go to the smaller name. Repeated rows
    give repeated rows, a null doc_id stays null and counts as empty text in
    the fold; an empty table gives an empty result; extra columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (fold(F.col("doc_id"), HELD_OUT_FOLDS) == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _keeper(model: Model | None, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of(model)
        for batch in text_batches(batches, 256):
            if reader:
                lang, score = reader.predict(texts_of(batch))
                keep = [k != UNDETERMINED and s >= min_score for k, s in zip(lang, score)]
                yield batch.filter(pa.array(keep, pa.bool_()))
    return run


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, **how) -> DataFrame:
    """The rows whose language is found with at least `min_score`, all columns as they are.

    Rejected: null and letterless texts, and texts whose positions agree on no
    language. Nothing stays if no language could be learned.
    """
    return docs.mapInArrow(_keeper(fit(docs, **how), min_score), docs.schema)
