from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import by_id, table
from pyspark.sql import functions as F

from strayrow.functions import columns as fc
from strayrow.operators import gaussian, kmeans, pca

F4 = ["f0", "f1", "f2", "f3"]


def test_mahalanobis_matches_numpy(spark, planted):
    x = planted.orderBy("id").toPandas()[F4].to_numpy()
    for k in (1, 2, 4):
        model = pca.fit_pca_mahalanobis(planted, F4, n_components=k)
        centred = x - x.mean(axis=0)
        _, s, vt = np.linalg.svd(centred, full_matrices=False)
        z = centred @ vt[:k].T
        want = np.sqrt((z**2 / (s[:k] ** 2 / (len(x) - 1))).sum(axis=1))
        got = by_id(model.flag(planted, "id"), "score")
        assert np.allclose(got, want)
        assert np.isclose(model.threshold, np.percentile(want, 90))
        flags = by_id(model.flag(planted, "id"), "flag")
        assert flags.mean() <= 0.1 + 1 / len(x)


def test_share_of_variance_and_signs(spark, planted):
    p = pca.fit_pca(planted, F4, 0.7)
    full = pca.fit_pca(planted, F4, 4)
    k = len(p.axes)
    assert full.ratio[:k].sum() > 0.7 >= full.ratio[: k - 1].sum()
    peaks = np.abs(full.axes).argmax(axis=1)
    assert (full.axes[np.arange(4), peaks] > 0).all()


def test_bad_component_counts(spark, planted):
    for k in (0, 5, 1.5, -1):
        with pytest.raises(ValueError, match="n_components"):
            pca.fit_pca(planted, F4, k)


def test_flat_directions_are_left_out(spark):
    x = np.random.default_rng(0).standard_normal((50, 2))
    x = np.c_[x, x[:, 0] + x[:, 1]]
    model = pca.fit_pca_mahalanobis(table(spark, x), ["f0", "f1", "f2"], n_components=3)
    got = by_id(model.flag(table(spark, x), "id"), "score")
    centred = x - x.mean(axis=0)
    inverse = np.linalg.pinv(np.cov(x, rowvar=False), rcond=1e-10)
    assert np.allclose(got, np.sqrt(np.einsum("ij,jk,ik->i", centred, inverse, centred)))


def test_large_projection_runs_as_matrix_product(spark, planted, monkeypatch):
    model = pca.fit_pca_mahalanobis(planted, F4, 3)
    small = by_id(model.flag(planted, "id"), "score")
    monkeypatch.setattr(pca, "MAX_EXPRESSION_TERMS", 1)
    assert np.allclose(by_id(model.flag(planted, "id"), "score"), small)


def best_of_all(p, y, candidates):
    """All candidates at once: one row of the matrix per candidate, F1 from set sizes."""
    grid = p.min() + np.arange(candidates) * ((p.max() - p.min()) / candidates)
    below = p[None, :] < grid[:, None]
    shared = below @ y
    f1 = 2 * shared / (below.sum(axis=1) + y.sum())
    first = int(np.argmax(f1))
    return (grid[first], f1[first]) if f1[first] > 0 else (0.0, 0.0)


@pytest.mark.parametrize("seed", range(6))
def test_epsilon_search_equals_the_matrix(spark, seed, monkeypatch):
    monkeypatch.setattr(gaussian, "GRID_RUNS", 7)
    rng = np.random.default_rng(seed)
    p = rng.random(120) if seed % 2 else rng.integers(0, 9, 120) / 8.0
    y = (rng.random(120) < 0.3 * (1.2 - p)).astype(int)
    y[0] = 1
    for candidates in (1, 13, 400):
        got = gaussian.search_epsilon(table(spark, p[:, None], y=y), "f0", "y", candidates)
        assert np.allclose(got, best_of_all(p, y, candidates), rtol=1e-13, atol=0)


def test_epsilon_without_labels_or_positives(spark):
    p = np.array([0.2, 0.4, 1.2])
    df = table(spark, p[:, None], y=np.zeros(3, dtype=int))
    for label in (None, "y"):
        epsilon, f1 = gaussian.search_epsilon(df, "f0", label, 10)
        assert (epsilon, f1) == (0.2 + 1.0 / 10, 1.0)


def test_equal_probabilities_flag_nothing(spark):
    x = np.array([[0.0], [2.0]] * 10)
    y = np.r_[np.ones(3, dtype=int), np.zeros(17, dtype=int)]
    for label in (None, "y"):
        model = gaussian.fit_gaussian(table(spark, x, y=y), ["f0"], label)
        flags = model.flag(table(spark, x), "id")
        assert by_id(flags, "score").min() == pytest.approx(model.epsilon)
        assert not by_id(flags, "flag").any()


def test_density_and_flat_feature(spark):
    x = np.random.default_rng(2).standard_normal((80, 3))
    model = gaussian.fit_gaussian(table(spark, x), ["f0", "f1", "f2"])
    want = np.prod(
        np.exp(-((x - x.mean(0)) ** 2) / (2 * x.var(0))) / np.sqrt(2 * math.pi * x.var(0)), axis=1
    )
    flags = model.flag(table(spark, x), "id")
    assert np.allclose(by_id(flags, "score"), want)
    assert by_id(flags, "flag").sum() == 1
    x[:, 1] = 5.0
    with pytest.raises(ValueError, match="f1"):
        gaussian.fit_gaussian(table(spark, x), ["f0", "f1", "f2"])


def test_own_centroid_is_the_nearest_and_the_mean(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.standard_normal((60, 2)) + c for c in ((0, 0), (12, 0), (0, 12))])
    model = kmeans.fit_kmeans(table(spark, x), ["f0", "f1"], 3)
    d = np.linalg.norm(x[:, None] - model.centroids[None], axis=2)
    assert np.allclose(by_id(model.flag(table(spark, x), "id"), "score"), d.min(axis=1))
    label = d.argmin(axis=1)
    for j in range(3):
        assert np.allclose(model.centroids[j], x[label == j].mean(axis=0))
    assert by_id(model.flag(table(spark, x), "id"), "flag").mean() <= 0.1 + 1 / len(x)


def test_many_centroids_run_in_batches(spark, planted, monkeypatch):
    model = kmeans.fit_kmeans(planted, F4, 3)
    small = by_id(model.flag(planted, "id"), "score")
    monkeypatch.setattr(kmeans, "MAX_EXPRESSION_TERMS", 1)
    assert np.allclose(by_id(model.flag(planted, "id"), "score"), small)


def test_elbow_geometry(spark):
    scores = [-100.0, -40.0, -20.0, -15.0, -12.0, -10.0]
    curve = spark.createDataFrame([(i + 1, s) for i, s in enumerate(scores)], "k int, score double")
    a, b = np.array([0.0, scores[0]]), np.array([7.0, scores[-1]])
    want = [
        abs(np.linalg.det(np.array([b - a, a - np.array([i, s])]))) / np.linalg.norm(b - a)
        for i, s in enumerate(scores)
    ]
    got = [r["distance"] for r in kmeans.elbow_distances(curve).orderBy("k").collect()]
    assert np.allclose(got, want)
    assert kmeans.elbow_pick(curve).first()["k"] == int(np.argmax(want)) + 1


def test_elbow_finds_three_clouds(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.standard_normal((60, 2)) + c for c in ((0, 0), (30, 0), (0, 30))])
    model = kmeans.fit_kmeans(table(spark, x), ["f0", "f1"], max_cluster_elbow=7)
    assert model.n_clusters in (2, 3)
    curve = kmeans.elbow_curve(table(spark, x), ["f0", "f1"], 4).orderBy("k").collect()
    assert np.isclose(curve[0]["score"], -((x - x.mean(0)) ** 2).sum())
    assert curve[0]["score"] < curve[1]["score"] < curve[2]["score"]


def test_scalar_kernels(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 9.0], [2.0, 2.0, 0.0, 9.0])], "a array<double>, b array<double>")
    row = df.select(
        fc.mean_absolute_error(F.col("a"), F.col("b")).alias("mae"),
        fc.neighbour_score(F.col("a"), 4, "median").alias("even"),
        fc.neighbour_score(F.slice("a", 1, 3), 3, "median").alias("odd"),
        fc.neighbour_score(F.col("a"), 4, "average").alias("mean"),
        fc.neighbour_score(F.col("a"), 4, "max_distance").alias("far"),
    ).first()
    assert tuple(row) == (1.25, 3.0, 2.0, 4.0, 9.0)
    with pytest.raises(ValueError, match="score function"):
        fc.neighbour_score(F.col("a"), 4, "mode")
