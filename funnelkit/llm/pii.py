"""Operator 1: personal data by patterns and a skip-chain conditional random field.

The patterns find the base spans. Around them a CRF labels the document's
*candidate* tokens: each base span, and outside of them the words with a digit or
`@`, cut at white space and separators. Adjacent digit groups that together end a
number of the base spans ("020 7946 0958" after +44 20 7946 0958) are one token,
and so is a word that is the local part of an address of the document, if that has
an inner sign or digit ("jo.smith", not "support"). Any other word is O by
definition and only serves as context. Factors:

* unary: a log-linear model of the token's shape and its neighbours' shapes,
  trained on the base labels of a bounded sample; base tokens are clamped;
* chain: consecutive candidates, from label pairs counted in the sample;
* skip: tokens anywhere in the document with one key (same letters and digits,
  same digits, same last seven digits, same local part of an address) share a
  potential that favours one label. More than two tokens with one key hang on a
  hub variable, so a token repeated n times costs n edges, not n squared.

Loopy sum-product messages run until they settle. A candidate whose entity label
wins joins the spans, if links of any number, skip or chain, lead from it to a base
span; base spans stay as they are. So a telephone number written once in full is
also found where it stands without its prefix. A document without a base span has
nothing that messages could carry, so its field is not run.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.common import sample_by_hash, text_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 100_000
SILVER_TRUST = 0.5        # unary weight of tokens without a base label: a miss of the patterns is no proof of O
ROUNDS, DAMPING, SETTLED = 20, 0.3, 1e-3
MIN_KEY = 5               # letters and digits that a shared key needs
SKIP_RANGE = 4.0, 6.0     # bounds of the skip factor's log-potential
MARGIN = 0.5              # probability of an entity label from which a token is a span

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
#: A match from inside a run of digits fails whenever one from its start does, so only starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s,;|=\"'<>(){}\[\]]+")
_HAS = re.compile(r"[0-9@]")
_GROUPS = re.compile(r"[0-9]+")
_GAP = re.compile(r"[\x20().-]{1,2}")
_STRUCTURED = re.compile(r".*[A-Za-z0-9][._+-][A-Za-z0-9]|.*[0-9]")
SUFFIX = 7                # digits at the end of a number that name it

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from each `@` outwards in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _ip_ok(match: str) -> bool:
    parts = [p.lstrip("0") for p in match.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """The base spans by kind as listed, then start."""
    out = emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip_ok(m.group())]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)
                if 8 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15]
    return out


# ------------------------------------------------------------ the graph of a document

def tokens(text: str, base: list[Span] = ()) -> list[tuple[int, int]]:
    """(start, end) of the candidate tokens, ascending and apart; base spans (the earlier of overlapping ones) are tokens."""
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(base, key=lambda s: (s[1], -s[2])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    locals_ = {text[a:b].partition("@")[0].lower() for kind, a, b in base if kind == "email"}
    locals_ = {x for x in locals_ if len(x) >= MIN_KEY and _STRUCTURED.match(x)}
    numbers = {_solid_digits(text[a:b]) for kind, a, b in base if kind in ("card", "phone")}
    free, at = [], 0
    for a, b in [*out, (len(text), len(text))]:
        runs = _digit_runs(text, at, a, numbers)
        free += runs
        for lo, hi in zip([at, *(r[1] for r in runs)], [*(r[0] for r in runs), a]):
            for m in _TOKEN.finditer(text, lo, hi):
                word = m.group().strip(".:!?")
                if word and (_HAS.search(word) or word.lower() in locals_):
                    start = m.start() + m.group().find(word)
                    free.append((start, start + len(word)))
        at = b
    return sorted(out + free)


def _solid_digits(text: str) -> str:
    return "".join(_GROUPS.findall(text))


def _digit_runs(text: str, lo: int, hi: int, numbers: set[str]) -> list[tuple[int, int]]:
    """Spans in text[lo:hi] of two or more adjacent digit groups that together are the end of one of `numbers`, zeros ahead aside."""
    if not numbers:
        return []
    ends = {n[-SUFFIX:] for n in numbers}
    groups = [(m.start(), m.end(), m.group()) for m in _GROUPS.finditer(text, lo, hi)]
    out: list[tuple[int, int]] = []
    for j in range(len(groups)):
        i, digits, best = j, groups[j][2], None
        while i and len(digits) < 20 and _GAP.fullmatch(text, groups[i - 1][1], groups[i][0]) and (not out or groups[i - 1][0] >= out[-1][1]):
            i -= 1
            digits = groups[i][2] + digits
            core = digits.lstrip("0")
            if len(core) >= SUFFIX and core[-SUFFIX:] in ends and any(n.endswith(core) for n in numbers):
                best = i
        if best is not None:
            a, b = groups[best][0], groups[j][1]
            opened = a > lo and text[a - 1] == "(" and text.find(")", a, b) >= 0
            out.append((a - opened, b))
    return out


def labels(spans: list[Span], toks: list[tuple[int, int]]) -> np.ndarray:
    """Label of each token by the base span that overlaps it most recently started; 0 is O."""
    out = np.zeros(len(toks), np.int64)
    starts = np.array([a for a, _ in toks], np.int64)
    ends = np.array([b for _, b in toks], np.int64)
    for kind, a, b in reversed(spans):
        out[np.searchsorted(ends, a, "right"):np.searchsorted(starts, b, "left")] = KINDS.index(kind) + 1
    return out


def features(text: str, toks: list[tuple[int, int]]) -> np.ndarray:
    """Binary shape features, one row a token."""
    rows = np.zeros((len(toks), 20), np.float32)
    for i, (a, b) in enumerate(toks):
        t = text[a:b]
        digits = sum("0" <= c <= "9" for c in t)
        rows[i, :12] = (1, "@" in t, t.count(".") == 3, digits == len(t), digits >= 7, digits >= 15, digits <= 2,
                        "-" in t, any(c.isalpha() for c in t), "=" in t, b - a > 24, t.count(".") == 1)
        rows[i, 12:16] = (text[max(0, a - 1):a] == "+" or t[:1] == "+", text[max(0, a - 1):a] == "(",
                          text[b:b + 1] == ")", digits == 4)
        rows[i, 16] = i > 0 and a - toks[i - 1][1] <= 2
        rows[i, 17] = i + 1 < len(toks) and toks[i + 1][0] - b <= 2
        rows[i, 18], rows[i, 19] = digits == 3, "." in t and "@" in t
    return rows


def keys(token: str) -> set[str]:
    """What a token shares with its repetitions and variants."""
    t = token.lower()
    solid = "".join(c for c in t if c.isalnum())
    out = {solid} if len(solid) >= MIN_KEY else set()
    digits = "".join(c for c in solid if "0" <= c <= "9")
    if len(digits) >= SUFFIX and len(digits) * 2 > len(solid):
        out |= {digits, "end:" + digits[-SUFFIX:]}
    local = t.partition("@")[0]
    if len(local) >= MIN_KEY:
        out.add("local:" + local)
    return out


def skip_groups(text: str, toks: list[tuple[int, int]]) -> list[list[int]]:
    """Token indexes that share a key, each set of tokens once."""
    by_key = defaultdict(list)
    for i, (a, b) in enumerate(toks):
        for k in keys(text[a:b]):
            by_key[k].append(i)
    return [list(g) for g in dict.fromkeys(tuple(g) for g in by_key.values() if len(g) > 1)]


def chain_edges(toks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidates next to each other: at most three characters apart."""
    return [(i, i + 1) for i in range(len(toks) - 1) if toks[i + 1][0] - toks[i][1] <= 3]


class Field:
    """Parameters: unary weights (features, labels), chain and skip log-potentials (labels, labels)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, unary: np.ndarray, chain: list[tuple[int, int]], groups: list[list[int]]) -> np.ndarray:
        """Approximate label probabilities of each node by damped loopy sum-product."""
        edges, hubs = [(i, j, 0) for i, j in chain], 0
        for g in groups:
            if len(g) == 2:
                edges.append((g[0], g[1], 1))
            else:
                edges += [(len(unary) + hubs, i, 1) for i in g]
                hubs += 1
        scores = np.concatenate([unary, np.zeros((hubs, unary.shape[1]))])
        if edges:
            i, j, kind = np.array(edges).T
            psi = np.stack([self.chain, self.skip])[kind]
            there = np.zeros((len(edges), unary.shape[1]))
            back = np.zeros_like(there)
            for _ in range(ROUNDS):
                belief = scores.copy()
                np.add.at(belief, j, there)
                np.add.at(belief, i, back)
                to_j = _log_sum((belief[i] - back)[:, :, None] + psi, 1)
                to_i = _log_sum((belief[j] - there)[:, None, :] + psi, 2)
                move = max(np.abs(to_j - there).max(), np.abs(to_i - back).max())
                there = DAMPING * there + (1 - DAMPING) * to_j
                back = DAMPING * back + (1 - DAMPING) * to_i
                if move < SETTLED:
                    break
            np.add.at(scores, j, there)
            np.add.at(scores, i, back)
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        return (p / p.sum(axis=1, keepdims=True))[:len(unary)]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans that the field adds to the base ones; none overlaps a base span."""
        toks = tokens(text, base) if base else []
        if not toks:
            return []
        known = labels(base, toks)
        groups = skip_groups(text, toks)
        if not groups or (known > 0).all():
            return []  # without a skip factor nothing carries a label to another token
        unary = SILVER_TRUST * (features(text, toks) @ self.unary)
        unary[known > 0] = 0
        unary[known > 0, known[known > 0]] = 20
        chain = chain_edges(toks)
        p = self.marginals(unary, chain, groups)
        best = p.argmax(axis=1)
        near = _reached(len(toks), [*chain, *((g[0], i) for g in groups for i in g[1:])], np.flatnonzero(known))
        return [(KINDS[best[i] - 1], a, b) for i, (a, b) in enumerate(toks)
                if near[i] and not known[i] and best[i] and p[i, best[i]] >= MARGIN]


def _reached(n: int, edges: list[tuple[int, int]], start: np.ndarray) -> np.ndarray:
    """Whether links lead from a node to one of `start`."""
    beside, seen, todo = defaultdict(list), np.zeros(n, bool), start.tolist()
    for i, j in edges:
        beside[i].append(j)
        beside[j].append(i)
    seen[start] = True
    while todo:
        new = [j for j in beside[todo.pop()] if not seen[j]]
        seen[new] = True
        todo += new
    return seen


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Normalised log-sum-exp over one axis of messages."""
    top = x.max(axis=axis, keepdims=True)
    out = np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)
    return out - out.max(axis=1, keepdims=True)


def train(texts: list[str], steps: int = 200) -> Field:
    """Unary weights by softmax regression, chain and skip potentials from label pairs of the base spans."""
    n = len(KINDS) + 1
    xs, ys = [np.zeros((0, 20), np.float32)], [np.zeros(0, np.int64)]
    chain, agree, differ = np.ones((n, n)), 1.0, 1.0
    for text in texts:
        base = base_spans(text)
        toks = tokens(text, base)
        if not toks:
            continue
        y = labels(base, toks)
        told = np.ones(len(toks), bool)  # a token that shares a key with a base span is no example of O
        for g in skip_groups(text, toks):
            if y[g].any():
                told[g] = y[g] > 0
        xs.append(features(text, toks)[told])
        ys.append(y[told])
        for i, j in chain_edges(toks):
            chain[y[i], y[j]] += 1
        for g in skip_groups(text, toks):
            kinds = y[g][y[g] > 0]
            if len(kinds):
                agree += (kinds == kinds[0]).sum() - 1
                differ += (kinds != kinds[0]).sum()
    x, y = np.concatenate(xs), np.concatenate(ys)
    w = np.zeros((20, n))
    for _ in range(steps if len(x) else 0):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        w -= 1.0 * (x.T @ p / len(x) + 1e-4 * w)
    share = chain / chain.sum()
    chance = share.sum(axis=1, keepdims=True) * share.sum(axis=0, keepdims=True)
    strength = float(np.clip(np.log(agree / differ), *SKIP_RANGE))
    skip = np.zeros((n, n))
    skip[range(1, n), range(1, n)] = strength
    return Field(w, np.clip(np.log(share / chance), -2, 2), skip)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Train on at most `sample_docs` documents with a candidate token, chosen by a hash of id and text."""
    rows = (docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).withColumn("one", F.lit(1)))
    key = F.concat_ws("/", "doc_id", F.md5("text"))
    return train(sorted(r.text for r in sample_by_hash(rows, key, ["one"], sample_docs, seed=1).select("text").toLocalIterator()))


def joined(spans: list[Span]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _finder(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            out = {"base": [], "added": []}
            for text in texts_of(batch):
                base = base_spans(text)
                out["base"].append(base)
                out["added"].append(field.added(text, base) if base else [])
            counts = [pa.array([sum(s[0] == k for s in b) for b in out["base"]], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b in out["base"]]
            spans = [joined(b + a) for b, a in zip(out["base"], out["added"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string()),
                 pa.array([len(a) for a in out["added"]], pa.int64())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])
    return run


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row and whole text.

    n_* count base spans. Null and empty texts have no span. Repeated rows give
    repeated rows, null doc_ids stay, an empty table gives an empty result;
    extra columns are not read. Equal label probabilities go to the first kind.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_finder(field), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                           "base_sha256 string, spans string, n_added long")
