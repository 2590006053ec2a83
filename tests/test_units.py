"""Sums, fits and training that come out the same however the table is cut."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from strayrow.functions import arrow
from strayrow.functions.network import Network
from strayrow.operators import autoencoder, kmeans, svm, units

F4 = [f"f{i}" for i in range(4)]


def partials(spark, rng, count, length):
    v = rng.standard_normal((count, length)) * 10.0 ** rng.integers(-8, 8, (count, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "unit long, v array<double>"), v


@pytest.mark.parametrize("count", [1, 3, 64, 65, 200, 1000])
def test_tree_sum_has_the_same_bits_for_every_partitioning(spark, monkeypatch, count):
    df, v = partials(spark, np.random.default_rng(count), count, 5)
    found = [arrow.sum_vectors(df.repartition(p, F.rand(p)), count, 5) for p in (1, 8, 200)]
    assert np.array_equal(found[0], found[1]) and np.array_equal(found[0], found[2])
    assert np.allclose(found[0], v.sum(axis=0), rtol=1e-9, atol=1e-6)
    # several levels of groups
    monkeypatch.setattr(arrow, "FEW_VECTORS", 4)
    deep = [arrow.sum_vectors(df.repartition(p), count, 5) for p in (1, 8)]
    assert np.array_equal(*deep) and np.allclose(deep[0], v.sum(axis=0), rtol=1e-9, atol=1e-6)


def test_tree_sum_leaves_out_missing_units(spark):
    df, v = partials(spark, np.random.default_rng(1), 300, 3)
    some = df.where("unit % 7 != 0 AND unit < 250")
    keep = [i for i in range(250) if i % 7]
    assert np.allclose(arrow.sum_vectors(some, 300, 3), v[keep].sum(axis=0), rtol=1e-9, atol=1e-6)
    assert np.array_equal(arrow.sum_vectors(df.limit(0), 300, 3), np.zeros(3))


def test_units_hold_every_row_and_count_copies(spark, monkeypatch):
    monkeypatch.setattr(units, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 3))
    x[:300] = x[0]
    sizes = []

    def add_up(matrix, copies, chunk):
        return np.concatenate([[copies.sum(), len(matrix)], copies @ matrix])

    for p in (1, 7):
        dealt = units.deal(table(spark, x).repartition(p), ["f0", "f1", "f2"], 900, rows_per_unit=50)
        sizes.append(dealt.add_up(add_up, 5))
        assert dealt.rows.select("unit").distinct().count() == dealt.count == 18
        dealt.release()
    assert np.array_equal(sizes[0], sizes[1])
    assert sizes[0][:2].tolist() == [900, 601]
    assert np.allclose(sizes[0][2:], x.sum(axis=0))


def test_parts_are_added_up_one_by_one(spark):
    x = np.arange(100.0)[:, None]
    df = table(spark, x)
    dealt = units.deal(df, ["f0"], 100, F.col("id") % 3, 3, [F.col("id")])
    got = [dealt.add_up(lambda m, w, _: np.array([m.sum()]), 1, part)[0] for part in range(3)]
    assert got == [x[k::3].sum() for k in range(3)]
    dealt.release()


def test_one_class_machine_has_the_same_bits_for_every_partitioning(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 3))
    x[:200] = x[0]
    fits = [svm.fit_one_class_svm(table(spark, x).repartition(p), ["f0", "f1", "f2"], 0.1) for p in (1, 9)]
    assert np.array_equal(fits[0].normal, fits[1].normal) and fits[0].threshold == fits[1].threshold


def plain_lloyd(x, centroids, steps=500):
    for _ in range(steps):
        at = ((x[:, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)
        means = np.array([x[at == c].mean(axis=0) if (at == c).any() else centroids[c] for c in range(len(centroids))])
        if np.allclose(means, centroids, atol=0, rtol=1e-15):
            break
        centroids = means
    return centroids, ((x - centroids[at]) ** 2).sum()


def test_fits_that_step_together_equal_single_fits(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.standard_normal((80, 2)) + c for c in ([0, 0], [9, 0], [0, 9], [1e3, 1e3])])
    df = table(spark, x)
    fits = kmeans.fit_every_k(df, ["f0", "f1"], range(1, 9), tol=0.0)
    sample, copies = svm.hashed_rows(df, ["f0", "f1"], 320, 4096, 0)
    starts = kmeans.spread_out(sample, copies, 8, 0)
    for k, fit in fits.items():
        centroids, inertia = plain_lloyd(x, starts[:k])
        assert fit.converged and np.allclose(np.sort(fit.centroids, axis=0), np.sort(centroids, axis=0))
        assert fit.inertia == pytest.approx(inertia, rel=1e-9) and fit.counts.sum() == 320
    cost = [fits[k].inertia for k in range(1, 9)]
    assert cost[0] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum()) and cost[3] < 0.01 * cost[0]


def test_one_scan_a_step(spark, monkeypatch):
    scans = []
    add_up = units.Units.add_up
    monkeypatch.setattr(units.Units, "add_up", lambda self, *a: scans.append(1) or add_up(self, *a))
    rng = np.random.default_rng(5)
    fits = kmeans.fit_every_k(table(spark, rng.standard_normal((200, 2))), ["f0", "f1"], range(1, 20), n_init=2)
    assert len(scans) == max(f.iterations for f in fits.values()) or len(scans) <= kmeans.MAX_ITER
    assert set(fits) == set(range(1, 20))


def test_more_clusters_than_distinct_rows(spark):
    x = np.repeat([[0.0, 0.0], [1.0, 1.0], [5.0, 5.0]], 10, axis=0)
    fits = kmeans.fit_every_k(table(spark, x), ["f0", "f1"], [1, 2, 3, 6])
    assert fits[6].inertia == fits[3].inertia == 0.0 and len(fits[6].centroids) == 3
    with pytest.raises(ValueError, match="empty"):
        kmeans.fit_every_k(table(spark, x).limit(0), ["f0", "f1"], [1])


def test_elbow_picks_the_planted_number(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([0.05 * rng.standard_normal((50, 2)) + 10 * np.array([c % 3, c // 3]) for c in range(6)])
    model = kmeans.fit_kmeans(table(spark, x), ["f0", "f1"], max_cluster_elbow=30)
    assert 5 <= model.n_clusters <= 8 and model.converged


@pytest.mark.parametrize("tasks", [1, 16])
def test_losses_do_not_depend_on_the_number_of_tasks(spark, planted, tasks):
    settings = dict(hidden_neurons=[3, 2, 3], epochs=3, dropout_rate=0.1, l2=0.01)
    model = autoencoder.fit_network(planted.repartition(tasks), F4, "id", **settings)
    other = autoencoder.fit_network(planted.coalesce(2), F4, "id", **settings)
    assert np.allclose(model.losses, other.losses, rtol=1e-9) and np.array_equal(model.weights, other.weights)


def test_a_step_is_that_of_the_whole_batch(spark, planted):
    # one batch, plain descent: the weights move against the mean gradient of all rows
    settings = dict(hidden_neurons=[3, 2, 3], epochs=1, dropout_rate=0.0, batch_size=10_000, optimizer="sgd", validation_split=0.0)
    model = autoencoder.fit_network(planted, F4, "id", **settings)
    x = planted.orderBy("id").toPandas()[F4].to_numpy()
    network = Network((4, 3, 2, 3, 4), "elu")
    start = network.initial("glorot_uniform", 0)
    loss, grad = network.gradient(start, x)
    assert np.allclose(model.weights, start - 0.01 * grad, rtol=1e-12) and model.losses[0] == pytest.approx(loss)


def test_copies_weigh_as_repeated_rows():
    rng = np.random.default_rng(7)
    x, copies = rng.standard_normal((20, 4)), rng.integers(1, 5, 20).astype(float)
    for loss in ("mse", "mae"):
        n = Network((4, 3, 2, 3, 4), "tanh", loss=loss, l1=0.1, l2=0.2)
        w = n.initial("glorot_uniform", 1)
        one, many = n.gradient(w, x, None, copies), n.gradient(w, np.repeat(x, copies.astype(int), axis=0))
        assert one[0] == pytest.approx(many[0]) and np.allclose(one[1], many[1])
        assert n.loss_of(w, x, copies) == pytest.approx(n.loss_of(w, np.repeat(x, copies.astype(int), axis=0)))


def test_elbow_step_holds_few_distances(spark, monkeypatch):
    x = np.random.default_rng(4).standard_normal((300, 3))
    whole = kmeans.fit_every_k(table(spark, x), ["f0", "f1", "f2"], range(1, 7))
    monkeypatch.setattr(kmeans, "STEP_CELLS", 16)
    parts = kmeans.fit_every_k(table(spark, x), ["f0", "f1", "f2"], range(1, 7))
    for k, fit in whole.items():
        near = ((x[:, None] - fit.centroids) ** 2).sum(axis=2).argmin(axis=1)
        assert np.array_equal(np.bincount(near, minlength=k), fit.counts)
        assert np.allclose(parts[k].centroids, fit.centroids) and np.isclose(parts[k].inertia, fit.inertia)


def test_few_files_are_cut_into_bounded_partitions(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strayrow import session
    from strayrow.operators import kmeans

    monkeypatch.setattr(session, "SMALL_ROWS", 1000)
    monkeypatch.setattr(session, "PARTITION_ROWS", 500)
    monkeypatch.setattr(kmeans, "SMALL_ROWS", 1000)
    rows = spark.range(10_000, numPartitions=1).select("id", (F.col("id") % 7).cast("double").alias("f0"))
    assert session.spread(rows, 10_000).rdd.getNumPartitions() == 20
    sizes = []
    fit = kmeans.fit_centroids

    def seen(df, *more):
        sizes.extend(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        return fit(df, *more)

    monkeypatch.setattr(kmeans, "fit_centroids", seen)
    kmeans.fit_kmeans(rows, ["f0"], 2)
    assert sum(sizes) == 10_000 and max(sizes) <= 600
