"""Hard negatives against all inner products in Python's whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from strayrow.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, v string, row string, score string, anchor_id string"


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, "v", "r", "s", "a") for r in rows], SCHEMA).repartition(3)
    found = hard_negatives.mine(table, lambda c: c % 50 == 0, **options).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found)


def brute_force(rows, positives=5, negatives=3):
    usable = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
              if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, v, y in usable:
        if i % 50 == 0 and (i not in anchors or (y, v) < anchors[i]):
            anchors[i] = (y, v)
    out = []
    for a, (label, v) in anchors.items():
        score = [(-sum(x * y for x, y in zip(v, w)), i, y) for i, w, y in usable if i != a]  # noqa: B905 shorter ones end in zeros
        same = sorted(x[:2] for x in score if x[2] == label)[:positives]
        for minus, p in same:
            hard = sorted((n, i) for n, i, y in score if y != label and 50 * -minus <= 100 * -n <= 95 * -minus)[:negatives]
            out += [(a, p, k, i, -minus, -n) for k, (n, i) in enumerate(hard, 1)]
    return sorted(out)


def clusters(seed, n, width, spread):
    """Vectors around a few centres, of several lengths; labels follow the centre, mostly."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    home = rng.integers(0, 6, n)
    v = centres[home] + spread * rng.standard_normal((n, width))
    v *= rng.choice([0.1, 0.5, 1.0, 3.0], n)[:, None]
    y = np.where(rng.random(n) < 0.2, rng.integers(0, 4, n), home % 4)
    return [(i, v[i].tolist(), int(y[i])) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_equals_all_inner_products(spark, monkeypatch, spread):
    # small buckets and blocks, so that several of each are used
    monkeypatch.setattr(hard_negatives, "BUCKET", 60)
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    rows = clusters(1, 900, 8, spread)
    assert mined(spark, rows) == brute_force(rows)


def test_odd_rows(spark):
    rows = clusters(2, 120, 4, 0.3)
    rows += [(150, None, 1), (200, [1.0, None, 0.0, 0.0], 1), (250, [float("nan"), 1.0, 1.0, 1.0], 1), (300, [math.inf, 1.0, 1.0, 1.0], 2),
             (350, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1), (400, [0.0] * 4, 1), (450, [], 2), (500, [1.0], 3),
             (50, [0.5] * 4, 0), (50, [0.5] * 4, 0), (7, [0.5] * 4, 3), (7, [0.5] * 4, 3), (550, [-1.0, -2.0, 0.0, 0.5, 3.0], 1)]
    assert mined(spark, rows) == brute_force(rows)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0], i % 2) for i in range(300)] + [(1000 + i, [0.9, 0.0], i % 2) for i in range(200)]
    assert mined(spark, rows) == brute_force(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-(2**18), 2**18, 8) + rng.random(8)).tolist(), i % 2) for i in range(120)]
    rows.append((121, [2.0**40] * 8, 0))  # its scores would not fit: left out
    assert mined(spark, rows) == brute_force(rows[:-1])


def test_no_rows_no_anchor_no_positive(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 0), (2, [1.0], 1)]) == []


def test_ranges_never_cut_a_vector_that_reaches_the_score():
    rng = np.random.default_rng(4)
    matrix = rng.integers(-300, 300, (500, 5)).astype(np.int32)
    bucket = hard_negatives.Bucket.of(np.arange(500), np.zeros(500, np.int64), matrix)
    vectors = rng.integers(-300, 300, (40, 5)).astype(np.int32)
    score = vectors.astype(np.int64) @ matrix.T.astype(np.int64)
    one = np.arange(40)
    pruned = 0
    for rank in (1, 10, 100):
        low = np.sort(score, axis=1)[:, -rank]
        search = hard_negatives.Search(one + 1000, one * 0, vectors, one, low, low * 0 + 2**60, rank, True)
        asked, begin, end = search.feasible(search.thresholds(), bucket)
        assert set(asked) == set(one)
        for i, b, e in zip(asked, begin, end, strict=True):
            for f, x, y in zip(search.focus[i], b, e, strict=True):
                assert set(np.flatnonzero(score[i] >= low[i])) <= set(bucket.order[f, x:y].tolist())
                pruned += 500 - (y - x)
    assert pruned > 40 * 3 * 3 * 100  # more than a fifth is cut on average
