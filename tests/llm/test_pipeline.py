"""The pipeline's stages against brute force on the smallest tables."""

from __future__ import annotations

import corpus_pipeline as cp
from funnelkit.llm import common, decontam, langid, mixing
from funnelkit.session import drop_scratch
from tests.conftest import SF_SMALL
from tests.llm.test_linking import brute_fingerprint, brute_roots
from tests.llm.test_texts import _brute_items


def test_stages_keep_what_brute_force_keeps(spark):
    docs = common.documents(spark, SF_SMALL)
    text = {r.doc_id: r.text for r in docs.collect()}

    one = common.saved(cp.STAGES[0][1](spark, docs, SF_SMALL), "t1")
    ids = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns
    assert {d for d, t in text.items() if not langid.runs(t or "")} <= set(text) - ids
    assert len(ids) >= 0.97 * len(text)

    two = common.saved(cp.STAGES[1][1](spark, one, SF_SMALL), "t2")
    fp = {d: brute_fingerprint(text[d]) for d in ids}
    root = brute_roots(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert sorted(r.doc_id for r in two.collect()) == sorted(d for d in ids if root[d] == d)

    three = common.saved(cp.STAGES[2][1](spark, two, SF_SMALL), "t3")
    items = {r.item_id: r.text for r in decontam.read_benchmark(spark, SF_SMALL).collect()}
    left = [r.doc_id for r in two.collect()]
    assert sorted(r.doc_id for r in three.collect()) == sorted(d for d in left if not _brute_items(text[d], items))

    four = common.saved(cp.STAGES[3][1](spark, three, SF_SMALL), "t4")
    want = {r.doc_id for r in mixing.mix(three).where("kept").collect()}
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == want

    five = cp.STAGES[4][1](spark, four, SF_SMALL)
    assert {r.doc_id for r in five.collect()} == want


def test_stages_take_an_empty_table(spark):
    docs = common.documents(spark, SF_SMALL).limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF_SMALL)
        assert out.collect() == []
        docs = out if out.columns == docs.columns else docs


def test_scratch_tables_can_be_dropped(spark):
    common.saved(spark.range(3), "scratch-test")
    assert drop_scratch(spark) >= 1
