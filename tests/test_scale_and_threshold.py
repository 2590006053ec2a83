from __future__ import annotations

import numpy as np
import pytest
from conftest import by_id, table

from strayrow.operators import scale, stats, threshold


def test_constant_column_is_only_shifted(spark):
    x = np.c_[np.arange(5.0), np.full(5, 7.0)]
    for kind in ("minmax", "standard"):
        scaled = scale.fit_scaler(table(spark, x), ["f0", "f1"], kind).transform(table(spark, x))
        assert np.allclose(by_id(scaled, "f1"), 0.0)
    new = table(spark, np.array([[1.0, 9.5]]))
    scaled = scale.fit_scaler(table(spark, x), ["f0", "f1"]).transform(new)
    assert by_id(scaled, "f1")[0] == 2.5


def test_new_data_is_not_clipped(spark):
    scaler = scale.fit_scaler(table(spark, np.array([[0.0], [2.0]])), ["f0"])
    assert by_id(scaler.transform(table(spark, np.array([[5.0]]))), "f0")[0] == 2.5


def test_standard_uses_the_population_deviation(spark):
    x = np.random.default_rng(0).standard_normal((50, 1))
    scaled = scale.fit_scaler(table(spark, x), ["f0"], "standard").transform(table(spark, x))
    assert np.allclose(by_id(scaled, "f0"), ((x - x.mean()) / x.std())[:, 0])


def test_unknown_scaler(spark):
    with pytest.raises(ValueError, match="scaler"):
        scale.fit_scaler(table(spark, np.ones((2, 1))), ["f0"], "robust")


@pytest.mark.parametrize("width", [3, 20])
def test_statistics_and_their_affine_image(spark, width):
    x = np.random.default_rng(1).standard_normal((200, width)) * np.arange(1, width + 1)
    x[:, 1] = 4.0
    names = [f"f{i}" for i in range(width)]
    got = stats.collect_stats(table(spark, x), names, with_cov=True)
    assert got.n == 200
    assert np.allclose(got.mean, x.mean(axis=0)) and np.allclose(got.var, x.var(axis=0))
    assert np.allclose(got.cov, np.cov(x, rowvar=False))
    shift, factor = x.min(axis=0), np.where(np.ptp(x, axis=0) > 0, np.ptp(x, axis=0), 1.0)
    image = got.affine(shift, factor)
    z = (x - shift) / factor
    assert np.allclose(image.mean, z.mean(axis=0)) and np.allclose(image.var, z.var(axis=0))
    assert np.allclose(image.cov, np.cov(z, rowvar=False))
    assert np.allclose(image.low, z.min(axis=0)) and np.allclose(image.high, z.max(axis=0))


def test_empty_table(spark):
    with pytest.raises(ValueError, match="empty"):
        stats.collect_stats(table(spark, np.ones((1, 1))).filter("id < 0"), ["f0"])


VALUES = {
    "normal": lambda r: r.standard_normal(3000),
    "wide": lambda r: np.exp(40 * r.standard_normal(3000)) * r.choice([-1, 1], 3000),
    "ties": lambda r: r.integers(0, 4, 3000).astype(float),
    "third": lambda r: np.where(r.random(3000) < 0.34, 2.5, r.random(3000) * 5),
    "constant": lambda r: np.full(100, 3.25),
    "zeros": lambda r: np.where(r.random(500) < 0.5, 0.0, -r.random(500)),
    "one": lambda r: np.array([4.5]),
}


@pytest.mark.parametrize("shape", VALUES)
def test_refinement_gives_the_interpolated_percentile(spark, shape, monkeypatch):
    monkeypatch.setattr(threshold, "FETCH_ROWS", 20)
    monkeypatch.setattr(threshold, "BUCKETS", 16)
    x = VALUES[shape](np.random.default_rng(3))
    df = table(spark, x[:, None])
    for q in (0.0, 0.1, 0.5, 0.9, 0.987, 1.0):
        want = np.percentile(x, 100 * q)
        for method in ("refine", "exact"):
            got = threshold.quantiles(df, {"f0": q}, method=method)["f0"]
            assert np.isclose(got, want, rtol=1e-12, atol=0), (method, q)


def test_weights_count_as_copies(spark):
    rng = np.random.default_rng(5)
    x, w = rng.standard_normal(400), rng.integers(1, 9, 400)
    df = table(spark, x[:, None], w=w)
    want = np.percentile(np.repeat(x, w), 90)
    for method in ("exact", "refine"):
        got = threshold.quantiles(df, {"f0": 0.9}, method=method, weight="w")["f0"]
        assert np.isclose(got, want)


def test_approximate_threshold_is_close_in_rank(spark):
    x = np.random.default_rng(6).standard_normal(5000)
    cut = threshold.contamination_threshold(
        table(spark, x[:, None]), "f0", 0.1, method="approx", accuracy=1000
    )
    assert abs((x > cut).mean() - 0.1) < 2e-3


def test_bad_contamination(spark):
    with pytest.raises(ValueError, match="contamination"):
        threshold.contamination_threshold(table(spark, np.ones((2, 1))), "f0", 1.5)


def test_infinite_scores_are_refined(spark):
    values = [float("inf")] * 3 + [float("-inf")] * 2 + [float(i) / 7 for i in range(95)]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    for q in (0.0, 0.01, 0.3, 0.77, 0.9, 1.0):
        exact, refined = (threshold.quantiles(df, {"s": q}, method=m)["s"] for m in ("exact", "refine"))
        assert exact == refined


@pytest.mark.parametrize("width", [12, 13])
def test_incomplete_rows_take_no_part(spark, width):
    names = [f"f{i}" for i in range(width)]
    rng = np.random.default_rng(0)
    x = rng.random((50, width))
    whole = spark.createDataFrame(x.tolist(), names)
    gaps = spark.createDataFrame([[None, *x[0, 1:].tolist()], [float("nan"), *x[1, 1:].tolist()]], whole.schema)
    got = stats.collect_stats(whole.union(gaps), names, with_cov=True)
    assert got.n == 50 and np.allclose(got.mean, x.mean(axis=0)) and np.allclose(got.cov, np.cov(x, rowvar=False))
