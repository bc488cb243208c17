import zlib

import numpy as np
import pytest

from meshwright.llm import language, quality, queries
from meshwright.llm.convnet import ByteConvNet, cut, windows

SF = "/root/testdata/sf0.01"


def test_windows_cover_every_byte():
    offsets = np.array([0, 0, 5, 105, 361])
    start, end, owner = windows(np.zeros(361, np.uint8), offsets, 40, 8)
    for k in range(4):
        held = set()
        for s in start[owner == k]:
            held |= set(range(s, min(s + 40, offsets[k + 1])))
        assert held == set(range(offsets[k], offsets[k + 1])) and (owner == k).sum() >= 1


def test_frozen_net_equals_the_trained_one():
    net = ByteConvNet({2: 3, 3: 4, 6: 5}, 7, 3, seed=1)
    x = np.random.default_rng(0).integers(0, 256, (300, 50)).astype(np.uint8)
    top, _ = net._pooled(x)
    h = np.maximum(np.maximum(top + net.p["b"], 0) @ net.p["w1"] + net.p["b1"], 0)
    assert np.allclose(net.frozen().logits(x), h @ net.p["w2"] + net.p["b2"], atol=1e-3)


def test_net_learns_a_pattern():
    rng = np.random.default_rng(0)
    x = rng.integers(97, 123, (400, 40)).astype(np.uint8)
    y = np.arange(400) % 2
    x[y == 1, 10:13] = list(b"#!?")
    net = ByteConvNet({3: 8}, 8, 2).fit(x, y, np.ones(400), steps=200).frozen()
    assert (net.logits(x).argmax(1) == y).mean() > 0.98


def test_quality_on_held_out_rows(spark):
    got = queries.op2_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_language_on_held_out_rows(spark):
    got = queries.op7_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == r.lang for r in got if r.held_out]) > 0.97


def test_odd_documents(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    found = {str(r.doc_id): r for r in language.identify(odd_docs, model).collect()}
    assert {k for k, r in found.items() if r.lang_pred == "und"} == {"1", "2", "3", "7"} and found["7"].score == 0
    assert language.identify(odd_docs, model).count() == 12 and language.identify(no_docs, model).count() == 0
    judge = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = quality.score_quality(odd_docs, judge).collect()
    assert len(scores) == 12 and all(0 <= r.score <= 1 for r in scores) and quality.score_quality(no_docs, judge).count() == 0
    kept = sum(r.predicted for r in scores)
    assert quality.keep_good(odd_docs, judge).count() == kept


def test_nothing_to_learn(spark, odd_docs, no_docs):
    model = language.train(no_docs)
    assert {r.lang_pred for r in language.identify(odd_docs, model).collect()} == {"und"}
    labels = spark.createDataFrame([(4, None, 0), (None, 1, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_quality(odd_docs, quality.train(odd_docs, labels)).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score == pytest.approx(0.982, abs=0.01) for r in quality.score_quality(odd_docs, quality.train(odd_docs, one)).collect())
