"""Operators 2, 4 and 8 and the component search against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from funnelkit.llm import chat, components, exact, queries, simhash
from tests.conftest import SF_CHECK, SF_SMALL
from tests.helpers import canon


def brute_fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_roots(items: dict, linked) -> dict:
    """item -> smallest item reachable; items: hashable and ordered."""
    parent = {x: x for x in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(items)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in names}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉß \t\n\x0b\x1c\u00a0.x", max_size=40), min_size=1, max_size=6))
def test_fingerprint_matches_definition(texts):
    got = simhash.majority([simhash.shingle_hashes(t) for t in texts])
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in texts]


def test_fingerprint_of_a_text_with_more_than_255_shingles():
    rng = random.Random(3)
    text = " ".join(rng.choice(["ab", "cd", "ef", "gh"]) + str(rng.randint(0, 99)) for _ in range(3000))
    assert int(simhash.majority([simhash.shingle_hashes(text)])[0]) == brute_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=40, unique=True), st.integers(1, 3))
def test_bk_tree_finds_all_within_the_radius(values, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
        tree.add(v)
    for v in values:
        assert sorted(tree.near(v, radius)) == sorted(w for w in values if (v ^ w).bit_count() <= radius)


def _near_fingerprints(n: int, seed: int) -> list[int]:
    """Random fingerprints, many of them 1 to 4 bits from another."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        x = rng.choice(out)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("shard_limit", [4096, 8])
def test_links_reach_what_all_pairs_reach(spark, shard_limit):
    values = _near_fingerprints(400, 5)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.vertex: r.root for r in components.components(simhash.links(fps, 2, shard_limit)).collect()}
    want = brute_roots(dict.fromkeys(signed), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert {x: got.get(x, x) for x in signed} == want


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(7, 7), (100, 101)]
    random.Random(1).shuffle(edges)
    got = {r.vertex: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_op8_matches_brute_force_over_the_table(spark):
    got = queries.op8_simhash_near_dedup(spark, SF_SMALL)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    fp = {d: brute_fingerprint(t) for d, t in texts.items()}
    root = brute_roots(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert rows == {d: (f"{fp[d]:016x}", root[d]) for d in texts}


EDGE = [(1, None, 0), (2, "", 0), (3, "same text here now", 1), (4, "SAME text\there now", 2), (4, "SAME text\there now", 2),
        (None, "same text here now", 3), (5, "word " * 30_000, 4), (6, "x", 5)]


def _edge(spark):
    return spark.createDataFrame([(*r, "fp", 9) for r in EDGE], "doc_id long, text string, key int, fp string, component_id long")


def test_op8_edge_cases(spark):
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.near_duplicates(_edge(spark)).collect())
    want = [(False, 1, 1), (False, 2, 1), (False, 3, 3), (False, 4, 3), (False, 4, 3), (False, 5, 5), (False, 6, 6), (True, None, 3)]
    assert got == want
    kept = simhash.keep_one(_edge(spark))
    assert kept.columns == _edge(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "6", "None"]
    assert simhash.near_duplicates(_edge(spark).limit(0)).collect() == []
    assert simhash.keep_one(_edge(spark).limit(0)).collect() == []


def test_keep_one_judges_rows_by_id_and_fingerprint(spark):
    docs = spark.createDataFrame([(1, "b b b b"), (1, "a a a a"), (1, "a a a a"), (1, None), (2, "q w e r"), (3, "same text here now"),
                                  (5, "same text here now"), (5, "totally different words go here too")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text or "") for r in simhash.keep_one(docs).collect()) == [
        (1, ""), (1, "a a a a"), (1, "b b b b"), (2, "q w e r"), (3, "same text here now"), (5, "totally different words go here too")]


# ------------------------------------------------------------ exact duplicates

def _duck(sql: str, sf: str = SF_CHECK, **frames):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        if t in frames:
            con.register(t, frames[t])
        else:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(sql)
    return canon(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    df = queries.QUERIES[name](spark, SF_CHECK)
    assert canon([tuple(r) for r in df.collect()], df.columns) == _duck(queries.ORACLE_SQL[name])


def _brute_exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc)
    out = []
    for docs in groups.values():
        keep = min((d for d in docs if d is not None), default=None)
        out += [(d, keep, len(docs), d == keep) for d in docs]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.crc32(t) % 2])
def test_exact_duplicates_compare_whole_texts(spark, digest):
    rows = [(r[0], r[1]) for r in EDGE] + [(10 + i, f"text {i % 5}\n\nx") for i in range(40)] + [(99, " lead"), (98, "lead")]
    docs = spark.createDataFrame([(*r, "b", "d") for r in rows], "doc_id long, text string, body string, digest string").repartition(7)
    got = exact.exact_duplicates(docs, salts=3, digest=digest)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=str) == _brute_exact(rows)
    assert exact.exact_duplicates(docs.limit(0)).collect() == []


# ------------------------------------------------------------ chat snapshots

def _brute_chat(rows):
    convs = defaultdict(set)
    for conv, turn, role, text in rows:
        convs[conv].add((turn, role, text))
    order = lambda t: tuple((x is not None, x if x is not None else 0 if i == 0 else "") for i, x in enumerate(t))
    seqs = {c: [t[1:] for t in sorted(v, key=order)] for c, v in convs.items()}
    kept = {c for c, s in seqs.items()
            if not any(o != c and s == seqs[o][:len(s)] and (len(seqs[o]) > len(s) or o < c) for o in seqs)}
    return {c: (len(s), c in kept, None if c in kept else min(o for o in kept if seqs[o][:len(s)] == s))
            for c, s in seqs.items()}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.sampled_from([None, 0, 1, 2, 700]), st.sampled_from(["user", None]),
                          st.sampled_from(["a", "b", None])), min_size=1, max_size=30))
def test_snapshots_collapse_as_defined(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, chunk int")
    decided, pieces = chat.collapse_and_render(df)
    got = {r.conv_id: (r.n_turns, r.kept, r.absorbed_by) for r in decided.collect()}
    assert got == _brute_chat(rows)
    want = sum(n for n, kept, _ in got.values() if kept)
    assert pieces.count() == want


def test_chat_empty_table_and_null_ids(spark):
    schema = "conv_id long, turn long, role string, text string"
    decided, pieces = chat.collapse_and_render(spark.createDataFrame([], schema))
    assert decided.collect() == [] and pieces.collect() == []
    decided, pieces = chat.collapse_and_render(spark.createDataFrame([(None, 0, "user", "x"), (2, 0, "user", "y")], schema))
    assert sorted((str(r.conv_id), r.kept) for r in decided.collect()) == [("2", True), ("None", True)]
    assert sorted(r.rendered for r in pieces.collect()) == ["<|im_start|>user\nx<|im_end|>\n", "<|im_start|>user\ny<|im_end|>\n"]


def test_planted_snapshots(spark):
    base = spark.read.parquet(f"{SF_CHECK}/conversations.parquet").where("conv_id < 20")
    snap = base.where("turn <= 2").withColumn("conv_id", F.col("conv_id") + 1000)
    decided, _ = chat.collapse_and_render(base.union(snap))
    longer = {r.conv_id for r in base.groupBy("conv_id").agg(F.max("turn").alias("t")).where("t > 2").collect()}
    rows = {r.conv_id: r for r in decided.collect()}
    for c in longer:
        assert not rows[c + 1000].kept and rows[c + 1000].absorbed_by is not None
