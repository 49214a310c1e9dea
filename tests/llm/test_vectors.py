"""Whitening and hard negatives against numpy and brute force; archives against an independent reader."""

from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import math

import duckdb
import numpy as np
import pytest

from funnelkit.llm import hardneg, warc, whitening
from funnelkit.llm.common import join_by_group
from funnelkit.llm.queries import ORACLE_SQL, QUERIES
from funnelkit.session import scratch_path
from tests.conftest import SF_CHECK
from tests.helpers import canon

VECTORS = "vec_id bigint, embedding array<float>, label int, x string, n int, cell int"


def vector_rows(rng, n, d=5, labels=3):
    return [(i, [float(np.float32(v)) for v in rng.normal(size=d)], int(rng.integers(labels)), "clash", 0, 0) for i in range(n)]


def oracle(name, **tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    rel = con.sql(ORACLE_SQL[name])
    return rel.fetchall(), rel.columns


# ------------------------------------------------------------- whitening

def white_brute(rows, components=4):
    """{vec_id: [(component, deviation, |whitened|, explained)]} with numpy's symmetric solver."""
    good = [(i, [math.floor(256.0 * c) for c in e]) for i, e, *_ in rows
            if e is not None and len(e) and all(c is not None and math.isfinite(c) for c in e)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    n, sums = len(fit), [sum(int(v) for v in col) for col in fit.T]
    centred = fit - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int(np.sum(values > 1e-9 * values[0])))
    out = []
    for i, x in good:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        y = (np.array(x) - np.array(sums) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        out += [(i, j + 1, n, dev, abs(y[j]), values[j] / values.sum()) for j in range(k)]
    return out


def same_whitening(found, want):
    assert len(found) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], round(r[4], 4))
    got = sorted([(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found], key=key)
    for a, b in zip(got, sorted(want, key=key)):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-7, abs=1e-9)
    assert all(r.identity_error < 1e-9 for r in found)


def test_whitening_of_the_whole_table_equals_a_dense_solver(spark):
    table = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    same_whitening(QUERIES["op11_embedding_whitening"](spark, SF_CHECK).collect(), white_brute(rows))


def test_whitening_edge_cases(spark):
    rows = vector_rows(np.random.default_rng(3), 40)
    rows += [rows[0], (None, rows[1][1], 1, "", 0, 0), (900, rows[2][1], None, "", 0, 0)]  # repeats count once in the fit
    odd = [(901, None, 1, "", 0, 0), (902, [1.0, None, 1.0, 1.0, 1.0], 1, "", 0, 0), (903, [float("nan")] * 5, 1, "", 0, 0),
           (904, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1, "", 0, 0), (905, [], 1, "", 0, 0), (906, [1.0, 2.0], 1, "", 0, 0)]
    found = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS)).collect()
    same_whitening(found, white_brute(rows))
    flat = [(i, [a, b, a, 0.5], 0, "", 0, 0) for i, (a, b) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)])]
    found = whitening.whiten(spark.createDataFrame(flat, VECTORS)).collect()  # rank 2: two components
    assert {r.component for r in found} == {1, 2} and max(r.identity_error for r in found) < 1e-12
    for few in ([], rows[:1] * 3, odd[:5]):  # no vector, or one: no direction has variance
        assert whitening.whiten(spark.createDataFrame(few, VECTORS)).count() == 0


@pytest.mark.parametrize("d", [1, 2, 3, 8, 65])
@pytest.mark.parametrize("kind", ["plain", "graded", "dependent", "equal"])
def test_qd_solver_against_numpy(d, kind):
    m = np.random.default_rng(d).normal(size=(d + 30, d))
    if kind == "graded":
        m = m @ np.diag(np.logspace(0, -9, d))
    if kind == "dependent" and d > 2:
        m[:, 2] = m[:, 0]
    if kind == "equal":
        m = np.linalg.qr(m)[0][:, :d]
    r = np.linalg.qr(m, mode="r")
    squares, vectors, trace = whitening.principal(r, 4)
    assert squares == pytest.approx(np.linalg.svd(m, compute_uv=False)[:len(squares)] ** 2, rel=1e-12)
    assert trace == pytest.approx(np.sum(m ** 2), rel=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(len(squares))).max() < 1e-10
    assert np.linalg.norm(m @ vectors, axis=0) ** 2 == pytest.approx(squares, rel=1e-10)


def test_small_singular_values_keep_their_digits():
    diagonal, above = np.logspace(0, -12, 13), np.logspace(-1, -13, 13)[:-1]
    exact = np.array([1 / float(v) for v in np.linalg.svd(np.linalg.inv(np.diag(diagonal) + np.diag(above, 1)), compute_uv=False)])
    assert np.sqrt(whitening.dqds(diagonal, above))[-3:] == pytest.approx(np.sort(exact)[::-1][-3:], rel=1e-9)


def test_triangles_of_many_tasks_merge(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = vector_rows(np.random.default_rng(5), 300)
    same_whitening(whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(11)).collect(), white_brute(rows))


def test_deviation_is_exact_or_null():
    x = np.array([[3_000_000_000, -7], [5, 1 << 40]], np.int64)
    sums = (12, -5)
    assert whitening.deviations(x, 3, sums) == [None if (v := sum((3 * int(a) - s) ** 2 for a, s in zip(r, sums))) >= 1 << 63 else v for r in x]


# ------------------------------------------------------------- hard negatives

def negatives_brute(rows):
    good, seen = [], set()
    for i, e, label, *_ in rows:
        if i is None or label is None or e is None or not len(e) or not all(c is not None and math.isfinite(c) for c in e):
            continue
        row = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256.0 * c) for c in e))
        if row not in seen:
            seen.add(row)
            good.append(row)
    out = []
    for a, label, x in (r for r in good if r[0] % 100 == 0):
        scored = [(-sum(p * q for p, q in zip(x, y)), i, other) for i, other, y in good if i != a]
        for s, positive, _ in sorted(t for t in scored if t[2] == label)[:5]:
            window = sorted(t for t in scored if t[2] != label and 30 * -s <= 100 * -t[0] <= 90 * -s)[:10]
            out += [(a, positive, rank, i, -s, -t) for rank, (t, i, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows):
    return sorted(tuple(r) for r in hardneg.mine(spark.createDataFrame(rows, VECTORS).repartition(5)).collect())


def test_hard_negatives_of_the_whole_table(spark):
    found = QUERIES["op12_hard_negatives"](spark, SF_CHECK)
    want, columns = oracle("op12_hard_negatives", embeddings=f"{SF_CHECK}/embeddings.parquet")
    assert canon([tuple(r) for r in found.collect()], found.columns) == canon(want, columns)


@pytest.mark.parametrize("shape", ["clusters", "one hot vector", "ties", "negative scores"])
def test_hard_negatives_against_brute_force(spark, monkeypatch, shape):
    for name, value in {"SHARD_ROWS": 40, "LEAF_ROWS": 4, "CELLS": 5, "FANOUT": 3, "BLOCK_ANCHORS": 2}.items():
        monkeypatch.setattr(hardneg, name, value)
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        v = rng.normal(size=4) * (0.2 if shape == "clusters" else 1.0) + (3.0 * np.eye(4)[i % 4] if shape == "clusters" else 0.0)
        if shape == "one hot vector" and i % 3 == 0:
            v = np.array([1.0, 0.5, 0.25, 0.0])
        if shape == "ties":
            v = np.round(v)
        if shape == "negative scores":
            v = np.abs(v) * (-1) ** i
        rows.append((i, [float(np.float32(c)) for c in v], int(rng.integers(3)), "clash", 0, 0))
    assert mined(spark, rows) == negatives_brute(rows)


def test_hard_negatives_edge_cases(spark):
    rows = vector_rows(np.random.default_rng(12), 230)
    odd = [(None, rows[0][1], 1, "", 0, 0), (1001, None, 1, "", 0, 0), (1002, [1.0] * 5, None, "", 0, 0),
           (1003, [float("nan")] * 5, 1, "", 0, 0), (1004, [None, 1.0, 1.0, 1.0, 1.0], 1, "", 0, 0), (1005, [], 1, "", 0, 0),
           (-100, rows[3][1], 2, "", 0, 0), rows[5], rows[5], (100, rows[7][1], 0, "", 0, 0)]
    want = negatives_brute(rows + odd)
    assert want and mined(spark, rows + odd) == want
    assert mined(spark, rows + odd + [(1006, [9.0] * 3, 1, "", 0, 0), (1007, [1e30] * 5, 1, "", 0, 0)]) == want
    assert mined(spark, []) == [] and mined(spark, odd[1:6]) == []
    assert mined(spark, [(100, [1.0], 1, "", 0, 0)]) == [] and mined(spark, [(100, [0.0], 1, "", 0, 0), (101, [0.0], 1, "", 0, 0)]) == []


def test_the_tree_skips_what_cannot_hold_a_result(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-20, 20, (200, 3)) + 900 * np.eye(3, dtype=int)[i] for i in range(3)])
    norm2 = (x ** 2).sum(axis=1)
    space = hardneg.Space(int(norm2.max()), 3)
    tree = hardneg.Tree(space, np.arange(600), np.zeros(600, int), space.matrix(x), norm2)
    leaves = []
    monkeypatch.setattr(hardneg.Block, "take", lambda self, active, ids, labels, rows: leaves.extend(ids))
    one = hardneg.Block(space, np.array([-1]), np.array([0]), space.matrix(x[:1]), norm2[:1],
                        np.array([[int(norm2[0] * 0.9)]]), np.array([[space.m2]]), True, 5)
    tree.search(one)
    assert set(range(200)) <= set(leaves) and len(leaves) < 400


# ------------------------------------------------------------- archives

PAGES = "page_id bigint, url string, html string, rec string, last int, value string"
BODIES = ["", "a", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "ä" * 5000, "line\nline\n", "\n\n", "☃" * 333 + "\r\n"]


def page_rows():
    rows = [(i, f"http://h/{i}", BODIES[i % len(BODIES)], "clash", 1, "") for i in range(40)]
    return rows + [(100, None, None, "", 0, ""), (101, "http://h/a b\r\nX: y", "odd url", "", 0, ""),
                   (None, "u", "null id", "", 0, ""), (None, "u", "null id", "", 0, ""), (7, "again", "other text", "", 0, "")]


def pages_brute(rows, least=0):
    first: dict = {}
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        first.setdefault(body, []).append(page)
    out, responses = [], set()
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        smallest = min((p for p in first[body] if p is not None), default=None)
        again = len(body) >= least and (page != smallest or (body, page) in responses)
        responses.add((body, page))
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if again else "response", smallest if again else None))
    return out


def by_text(rows):
    return sorted(map(str, rows))


def plain_records(folder):
    """An independent reader of whole archives: (headers, block) of each record."""
    for path in sorted(glob.glob(f"{folder.removeprefix('file:')}/*.gz")):
        data, at = gzip.open(path, "rb").read(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            version, *lines = data[at:end].decode().split("\r\n")
            assert version == "WARC/1.1"
            head = dict(line.split(": ", 1) for line in lines)
            assert len(head) == len(lines)
            size = int(head["Content-Length"])
            block, at = data[end + 4:end + 4 + size], end + 4 + size + 4
            assert data[at - 4:at] == b"\r\n\r\n"
            yield head, block


@pytest.mark.parametrize("chunk_bytes", [1, 7, 1 << 20])
@pytest.mark.parametrize("least", [0, 10])
def test_archives_round_trip(spark, chunk_bytes, least):
    rows = page_rows() if chunk_bytes > 1 else [r for r in page_rows() if len(r[2] or "") < 100]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, chunk_bytes, least)
    back = warc.read_archives(spark, path).collect()
    want = pages_brute(rows, least)
    got = [tuple(r) for r in back]
    assert by_text(got) == by_text(want)
    bodies: dict = {}
    for head, block in plain_records(path):
        origin = head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"])
        if head["WARC-Type"] != "continuation":
            http, block = block.split(b"\r\n\r\n", 1)
            assert http.startswith(b"HTTP/1.1 200 OK\r\n")
        assert len(block) <= chunk_bytes
        bodies.setdefault(origin, []).append((int(head.get("WARC-Segment-Number", 1)), block, head))
    texts = sorted(b"".join(b for _, b, _ in parts) for parts in bodies.values() if parts[0][2]["WARC-Type"] == "response")
    assert texts == sorted((r[2] or "").encode() for r, w in zip(rows, want) if w[3] == "response")
    for parts in bodies.values():
        assert [n for n, *_ in parts] == list(range(1, len(parts) + 1))  # segments in order, in one archive


def test_archives_of_an_empty_table(spark):
    assert warc.roundtrip(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_of_the_whole_table(spark):
    found = QUERIES["op13_warc_records"](spark, SF_CHECK)
    want, columns = oracle("op13_warc_records", pages=f"{SF_CHECK}/pages.parquet")
    assert canon([tuple(r) for r in found.collect()], found.columns) == canon(want, columns)


def test_incremental_digests_and_chunks(spark):
    table = warc.chunk_table(spark.createDataFrame([(1, "u", "ab☃" * 10, "", 0, "")], PAGES), 8).orderBy("chunk_no").collect()
    body = ("ab☃" * 10).encode()
    assert [r.chunk_no for r in table] == list(range(7)) and [r.last for r in table] == [False] * 6 + [True]
    for r in table:
        assert r.so_far == min(8 * (r.chunk_no + 1), len(body)) and bytes(r.data) == body[8 * r.chunk_no:r.so_far]
        assert r.sha1 == base64.b32encode(hashlib.sha1(body[:r.so_far]).digest()).decode()


def test_a_damaged_archive_is_an_error():
    def read(data):
        parser = warc._Parser()
        rows = list(parser.feed(data))
        parser.close()
        return rows

    body = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    digest = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    record = (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:5>\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
              f"Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    assert read(record * 2) == [(5, 5, digest, "response", None)] * 2
    for bad in (record[:-9], record.replace(b"hello", b"hallo"), record.replace(b"Length: 43", b"Length: 42"), b"x" + record):
        with pytest.raises(ValueError):
            read(bad)
    parser, rows = warc._Parser(), []
    for i in range(len(record)):
        rows += parser.feed(record[i:i + 1])  # any cut of the stream gives the same
    parser.close()
    assert rows == [(5, 5, digest, "response", None)]


def test_join_by_group_keeps_every_row(spark, monkeypatch):
    from funnelkit.llm import common

    rows = spark.createDataFrame([(i, k) for i, k in enumerate("a" * 50 + "b" * 3 + "c")] + [(99, None)], "id int, k string")
    lookup = spark.createDataFrame([("a", 50, "A"), ("b", 3, "B")], "k string, size int, v string")
    want = [(i, {"a": "A", "b": "B"}.get(k)) for i, k in enumerate("a" * 50 + "b" * 3 + "c")] + [(99, None)]
    for hot, limit in ((10, 10), (1, 1), (1, 0), (4096, 10)):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        monkeypatch.setattr(common, "MAX_HOT", limit)
        assert sorted((r.id, r.v) for r in join_by_group(rows, lookup, ["k"], "size").collect()) == sorted(want)
