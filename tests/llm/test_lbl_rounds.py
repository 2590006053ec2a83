"""The log-bilinear network learns from every training row, not from a sample."""

from __future__ import annotations

import numpy as np

from strayrow.llm import lbl
from strayrow.llm.ranks import bounded_sample


def test_rare_contexts_are_learned_from_all_rows(spark):
    rng = np.random.default_rng(0)
    # 12,000 rows, of which 40 hold a word pair that only context can tell; a sample of 3,000 has none of them
    sample = {r["doc_id"] for r in bounded_sample(spark.range(12_000).toDF("doc_id"), "doc_id", 3000, "lbl").collect()}
    pairs = [i for i in range(12_000) if i not in sample][:40]
    rows = [(i, "left right " * 20 if i in pairs else " ".join(f"w{k}" for k in rng.integers(0, 50, 8))) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lbl.score_texts(docs.where(docs["doc_id"].isin(pairs)), docs).agg({"score": "avg", "base_score": "avg"}).first()
    assert got["avg(score)"] > got["avg(base_score)"] + 10


def test_shares_count_all_tokens():
    counts = lbl.Counts(10, 3, 2, np.arange(2, dtype=np.uint64), np.array([5, 2]), np.array([0, lbl.FREQUENT], np.int32), np.array([3, *[0] * (lbl.TAILS - 1)]), np.zeros(lbl.TAILS, np.int64))
    share = lbl.class_share(counts)
    assert abs(share.sum() - 1) < 1e-12
    assert np.allclose(share[[0, lbl.FREQUENT, lbl.END]] * (10 + 0.5 * lbl.CLASSES) - 0.5, [5, 3, 2])


def test_rows_of_one_place_are_added_up():
    rng = np.random.default_rng(3)
    for n in (1, 50, 3000):
        at, rows = rng.integers(0, 40, n), rng.normal(size=(n, 5)).astype(np.float32)
        got, expected = np.ones((64, 5), np.float32), np.ones((64, 5))
        lbl.add_rows(got, at, rows)
        np.add.at(expected, at, rows)
        assert np.allclose(got, expected, atol=1e-4)
    # all work on the batch's largest array is in single precision
    share = lbl.smoothed(np.ones(lbl.CLASSES))
    model = lbl.start(share)
    lbl.contrast(model, lbl.fresh_squares(model), share, *rng.integers(0, lbl.CLASSES, (3, 64)), 0.01, rng)
    assert all(p.dtype == np.float32 and np.isfinite(p).all() for p in lbl.places_of(model))
