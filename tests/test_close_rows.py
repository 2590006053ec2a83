"""K-Means looks only at centroids that can be near, over units of distinct rows that lie close."""

from __future__ import annotations

import numpy as np
from conftest import table
from pyspark.sql import functions as F

from strayrow.functions import arrow
from strayrow.operators import kmeans, units


def test_no_nearest_centroid_is_left_out():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5):
        centroids = rng.standard_normal((60, width))
        first = np.r_[0, 1, 6, 30, 60]
        for scale in (0.0, 0.01, 0.3, 3.0):
            x = rng.standard_normal(width) + scale * rng.standard_normal((200, width))
            possible = kmeans._possible(x, centroids, first)
            for a, b in zip(first[:-1], first[1:]):
                near = ((x[:, None] - centroids[a:b]) ** 2).sum(axis=2).argmin(axis=1) + a
                assert possible[near].all()
    assert possible.sum() <= 60 and kmeans._possible(x[:1], centroids, first).sum() < 12


def test_steps_equal_those_over_all_centroids(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.standard_normal((400, 2)), 6 + rng.standard_normal((300, 2)), np.repeat([[2.0, 9.0]], 90, axis=0)])
    monkeypatch.setattr(kmeans, "LLOYD_ROWS", 64)
    few = kmeans.fit_every_k(table(spark, x), ["f0", "f1"], range(1, 15), tol=0.0)
    monkeypatch.setattr(kmeans, "_possible", lambda m, c, first: np.ones(len(c), dtype=bool))
    plain = kmeans.fit_every_k(table(spark, x).repartition(5), ["f0", "f1"], range(1, 15), tol=0.0)
    for k, fit in few.items():
        assert np.allclose(fit.centroids, plain[k].centroids) and np.array_equal(fit.counts, plain[k].counts)
        assert np.isclose(fit.inertia, plain[k].inertia) and fit.converged


def test_units_follow_from_the_distinct_rows(spark):
    once = spark.range(300).select((F.col("id") % 100).cast("double").alias("f0"), (F.col("id") % 3).cast("double").alias("f1"))
    many = once.crossJoin(spark.range(40).select(F.col("id").alias("copy"))).drop("copy")
    found = []
    for df, n in ((once, 300), (many.repartition(3), 12_000)):
        x = np.array(sorted({tuple(r) for r in once.collect()}))
        dealt = units.deal(df, ["f0", "f1"], n, rows_per_unit=64, places=units.Places.of(x))
        assert dealt.rows.agg(F.sum("w")).first()[0] == n
        found.append((dealt.count, dealt.add_up(lambda m, w, _: np.r_[len(m), w @ m / w.sum()], 3)[0]))
        spread = dealt.rows.select("unit", F.element_at("f", 1).alias("a")).groupBy("unit").agg(F.max("a") - F.min("a")).collect()
        assert max(r[1] for r in spread) < 60
        dealt.release()
    assert found[0] == found[1] and found[0][1] == 300


def test_units_are_as_many_as_the_driver_adds_up():
    x = np.random.default_rng(3).standard_normal((5000, 2))
    places = units.Places.of(x)
    sizes = np.bincount(places.leaf(x), minlength=places.leaves)
    assert len(sizes) == 512 and sizes.min() >= 5 and sizes.max() <= 15
    assert arrow.FEW_VECTORS == 64 and units.Places.of(x[:3]).leaves == 1


def test_fits_have_the_same_bits_for_every_partitioning(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "LLOYD_ROWS", 64)
    x = np.random.default_rng(4).standard_normal((900, 3))
    f = ["f0", "f1", "f2"]
    one, other = (kmeans.fit_every_k(table(spark, x).repartition(p), f, range(1, 12)) for p in (1, 9))
    for k in one:
        assert np.array_equal(one[k].centroids, other[k].centroids) and one[k].inertia == other[k].inertia


def test_rows_with_missing_cells_leave_out_nothing(spark, monkeypatch):
    x = np.random.default_rng(5).standard_normal((200, 2))
    df = table(spark, x).withColumn("f1", F.when(F.col("id") % 40 != 3, F.col("f1")))
    few = kmeans.fit_every_k(df, ["f0", "f1"], range(1, 6), max_iter=3)
    monkeypatch.setattr(kmeans, "_possible", lambda m, c, first: np.ones(len(c), dtype=bool))
    plain = kmeans.fit_every_k(df, ["f0", "f1"], range(1, 6), max_iter=3)
    for k, fit in few.items():
        assert np.array_equal(fit.counts, plain[k].counts) and fit.counts.sum() == 200
        assert np.allclose(fit.centroids, plain[k].centroids, equal_nan=True)
