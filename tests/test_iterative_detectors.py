from __future__ import annotations

import numpy as np
import pytest
from conftest import by_id, table
from pyspark.sql import functions as F

from strayrow.functions import network as net
from strayrow.operators import autoencoder, forest, kmeans, svm, units

F4 = ["f0", "f1", "f2", "f3"]


# Isolation forest


def test_planted_points_are_easier_to_isolate(spark, planted):
    model = forest.fit_isolation_forest(planted, F4, "id", seed=3)
    flags = model.flag(planted, "id")
    scores = by_id(flags, "score")
    assert (scores > 0).all() and (scores < 1).all()
    assert scores[-12:].min() > np.median(scores[:600])
    assert by_id(flags, "flag").mean() <= 0.1 + 1 / 612
    assert by_id(flags, "flag")[-12:].all()


def test_forest_does_not_depend_on_partitions(spark, planted):
    a = forest.fit_isolation_forest(planted.repartition(1), F4, "id", n_estimators=20)
    b = forest.fit_isolation_forest(planted.repartition(7, "f1"), F4, "id", n_estimators=20)
    for name in ("roots", "feature", "cut", "left", "right", "path"):
        assert np.array_equal(getattr(a, name), getattr(b, name))
    assert a.threshold == b.threshold
    c = forest.fit_isolation_forest(planted, F4, "id", n_estimators=20, seed=1)
    assert not np.array_equal(a.cut, c.cut)


def test_large_tables_give_every_tree_its_own_rows(spark):
    df = spark.range(20_000).select("id", F.randn(1).alias("f0"), F.randn(2).alias("f1"))
    drawn = forest._draw(df, ["id"], ["f0", "f1"], 20_000, 5, 256, 0)
    sizes = {r["tree"]: r["count"] for r in drawn.groupBy("tree").count().collect()}
    assert set(sizes) == set(range(5)) and all(256 <= n < 600 for n in sizes.values())
    assert drawn.select("_id").distinct().count() == sum(sizes.values())


def test_small_tables_are_drawn_anew_per_tree(spark, planted):
    drawn = forest._draw(planted, ["id"], F4, 612, 6, 256, 0)
    sizes = {r["tree"]: r["count"] for r in drawn.groupBy("tree").count().collect()}
    assert set(sizes) == set(range(6)) and all(256 <= n < 600 for n in sizes.values())


def test_a_repeated_id_takes_one_place(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 2))
    rows = table(spark, x).withColumn("id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")))
    drawn = forest._draw(rows, ["id"], ["f0", "f1"], 3000, 4, 256, 0)
    counts = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("_id").alias("ids")).collect()
    assert len(counts) == 4 and all(r["n"] == r["ids"] >= 256 for r in counts)
    models = [forest.fit_isolation_forest(rows.repartition(p), ["f0", "f1"], "id", n_estimators=4) for p in (1, 7)]
    for name in ("roots", "feature", "cut", "left", "right", "path"):
        assert np.array_equal(*(getattr(m, name) for m in models))
    # the least row of the id stands for it
    cells = drawn.where("_id = '{\"id\":0}'").select("f0").distinct().collect()
    assert {r["f0"] for r in cells} <= {min(map(tuple, x[::3]))[0]}


def test_tree_is_a_partition_of_its_rows():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((64, 2))
    nodes = forest._grow(x, np.array([0, 1]), 20, rng)
    leaves = [n for i, n in enumerate(nodes) if n[2] == i]
    assert len(leaves) == 64 and len(nodes) == 127


def test_feature_and_bootstrap_options(spark, planted):
    model = forest.fit_isolation_forest(
        planted, F4, "id", n_estimators=10, max_features=1, bootstrap=True
    )
    inner = model.left != np.arange(len(model.left))
    tree = np.searchsorted(model.roots, np.arange(len(model.left)), side="right")
    assert all(len(set(model.feature[inner & (tree == t)])) == 1 for t in range(1, 11))
    assert forest.feature_count(0.5, 4) == 2 and forest.feature_count(3, 4) == 3
    for bad in (0, 5, 1.5, True):
        with pytest.raises(ValueError, match="feature"):
            forest.feature_count(bad, 4)


def test_average_path():
    harmonic = 2 * (np.log(255) + forest.EULER_GAMMA) - 2 * 255 / 256
    assert np.allclose(forest.average_path(np.array([0, 1, 2, 256])), [0, 0, 1, harmonic])


# One-class support vector machine


def test_share_of_flagged_rows(spark, planted):
    for nu in (0.05, 0.2):
        model = svm.fit_one_class_svm(planted, F4, contamination=nu)
        flags = by_id(model.flag(planted, "id"), "flag")
        assert abs(flags.mean() - nu) <= 0.02
        assert by_id(model.flag(planted, "id"), "flag")[-12:].mean() > 0.5


@pytest.mark.parametrize("kernel", svm.KERNELS)
def test_kernels(spark, planted, kernel):
    model = svm.fit_one_class_svm(planted, F4, 0.1, kernel=kernel, gamma="auto", coef0=1.0)
    assert abs(by_id(model.flag(planted, "id"), "flag").mean() - 0.1) <= 0.02


def test_solution_meets_the_optimality_conditions(spark):
    """The normal is the mean of a weighting within the bounds, full below the cut."""
    x = np.random.default_rng(5).standard_normal((300, 2))
    df = table(spark, x)
    model = svm.fit_one_class_svm(df, ["f0", "f1"], 0.2, tol=1e-6, max_iter=400)
    phi = model.map(x)
    s = phi @ model.normal
    lowest = np.sort(s)[:60].mean()
    # No weighting within the bounds has a smaller projection than the normal itself.
    assert model.normal @ model.normal - lowest <= 1e-3 * (model.normal @ model.normal)


def test_exact_features_reproduce_the_kernel(spark):
    x = np.random.default_rng(6).standard_normal((100, 3))
    from strayrow.operators import stats

    df = table(spark, x)
    names = ["f0", "f1", "f2"]
    s, rows = stats.collect_stats(df, names), units.deal(df, names, 100)
    gamma = svm.gamma_value("scale", rows, s)
    assert np.isclose(gamma, 1 / (3 * x.var()))
    mapping = svm._kernel_map(df, rows, names, s, "rbf", "scale", 0.0, 3, 256, 0)
    k = svm.kernel_values(x, x, "rbf", gamma, 0.0, 3)
    assert np.allclose(mapping(x) @ mapping(x).T, k, atol=1e-6)


def test_copies_on_the_cut(spark):
    """A third of the rows are one point; the lowest share is still met exactly."""
    x = np.random.default_rng(7).standard_normal((300, 2))
    x[:100] = [3.0, 3.0]
    mapping = svm.KernelMap("linear", 1.0, 0.0, 3, np.zeros((0, 0)), np.zeros((0, 0)))
    normal = np.array([-1.0, -1.0])
    df, names = table(spark, x), ["f0", "f1"]
    s, rows = x @ normal, units.deal(df, names, 300)
    want = np.sort(s)[:90].mean()
    for edges in (
        svm._exact_edges(df, names, mapping, normal, 0.3),
        svm._edges(s, 0.3),
        np.array([-6.5, -5.9, 10.0]),
    ):
        got, missed = svm._lowest_mean(rows, mapping, normal, 0.3, 300, edges)
        assert want - 1e-9 <= got @ normal <= want + missed + 1e-9
    assert svm._lowest_mean(rows, mapping, normal, 0.3, 300, np.array([-9.0])) is None


def test_wrong_bands_fall_back_to_all_rows(spark, planted, monkeypatch):
    right = svm.fit_one_class_svm(planted, F4, 0.1)
    monkeypatch.setattr(svm, "_edges", lambda scores, share, copies=None: np.array([scores.min() - 1.0]))
    other = svm.fit_one_class_svm(planted, F4, 0.1)
    a, b = (m.normal / np.linalg.norm(m.normal) for m in (right, other))
    assert a @ b > 0.999


def test_shortest_vector_in_a_hull():
    rng = np.random.default_rng(8)
    corners = rng.standard_normal((12, 4)) + 1.0
    w = svm.shortest_in_hull(corners)
    v = w @ corners
    assert w.min() >= 0 and np.isclose(w.sum(), 1.0)
    assert (corners @ v).min() >= v @ v - 1e-9


def test_bad_svm_arguments(spark, planted):
    with pytest.raises(ValueError, match="kernel"):
        svm.fit_one_class_svm(planted, F4, kernel="laplace")
    with pytest.raises(ValueError, match="gamma"):
        svm.fit_one_class_svm(planted, F4, gamma=-1.0)
    with pytest.raises(ValueError, match="contamination"):
        svm.fit_one_class_svm(planted, F4, contamination=0.0)


# Autoencoder


@pytest.mark.parametrize("activation", [a for a in net.ACTIVATIONS if a != "exponential"])
@pytest.mark.parametrize("loss", net.LOSSES)
def test_gradient_against_differences(activation, loss):
    rng = np.random.default_rng(1)
    n = net.Network((4, 3, 2, 3, 4), activation, loss=loss, l1=0.01, l2=0.02)
    w = n.initial("glorot_uniform", 2)
    # Biases away from zero keep the inputs off the kinks.
    w += 0.1 * rng.standard_normal(len(w))
    x = rng.standard_normal((6, 4))
    _, grad = n.gradient(w, x)
    step = 1e-6 * np.eye(len(w))
    slope = [(n.gradient(w + e, x)[0] - n.gradient(w - e, x)[0]) / 2e-6 for e in step]
    assert np.abs(grad - slope).max() < 1e-6


def test_gradient_of_the_exponential():
    n = net.Network((3, 2, 3), "exponential")
    w = 0.1 * n.initial("glorot_uniform", 2)
    x = np.random.default_rng(1).standard_normal((6, 3))
    _, grad = n.gradient(w, x)
    slope = [
        (n.gradient(w + e, x)[0] - n.gradient(w - e, x)[0]) / 2e-6 for e in 1e-6 * np.eye(len(w))
    ]
    assert np.abs(grad - slope).max() < 1e-6


@pytest.mark.parametrize("name", net.OPTIMIZERS)
def test_optimizers_lower_the_loss(name):
    n = net.Network((4, 3, 4), "tanh")
    w = n.initial("glorot_uniform", 0)
    x = np.random.default_rng(2).standard_normal((50, 4))
    before = n.loss_of(w, x)
    optimizer = net.Optimizer(name)
    memory, counters = optimizer.initial(len(w))
    for _ in range(200):
        optimizer.step(w, n.gradient(w, x)[1], memory, counters)
    assert n.loss_of(w, x) < before


@pytest.mark.parametrize("name", net.INITIALIZERS)
def test_initializers(name):
    w = net.INITIALIZERS[name](np.random.default_rng(3), (40, 20))
    assert w.shape == (40, 20) and np.isfinite(w).all()


def test_dropout_keeps_the_mean():
    n = net.Network((4, 50, 4), "relu", dropout=0.5)
    w = n.initial("he_normal", 0)
    x = np.ones((200, 4))
    rng = np.random.default_rng(4)
    with_dropout = [n.gradient(w, x, rng)[0] for _ in range(20)]
    assert len(set(with_dropout)) == 20


def test_loss_falls_and_planted_rows_stand_out(spark, planted):
    settings = dict(hidden_neurons=[4, 2, 2, 4], epochs=15, dropout_rate=0.0)
    model = autoencoder.fit_autoencoder(planted, F4, "id", **settings)
    assert model.losses[-1] < model.losses[0]
    flags = model.flag(planted, "id")
    scores = by_id(flags, "score")
    assert scores[-12:].mean() > 2 * scores[:600].mean()
    assert by_id(flags, "flag").mean() <= 0.1 + 1 / 612
    again = np.array(by_id(model.reconstruct(planted, "id"), "reconstruction").tolist())
    x = planted.orderBy("id").toPandas()[F4].to_numpy()
    assert np.allclose(np.abs(again - x).mean(axis=1), scores)


def test_training_does_not_depend_on_partitions(spark, planted, monkeypatch):
    monkeypatch.setattr(autoencoder, "BATCH_UNIT_ROWS", 8)
    settings = dict(hidden_neurons=[3, 2, 3], epochs=2)
    a = autoencoder.fit_network(planted.repartition(1), F4, "id", **settings)
    b = autoencoder.fit_network(planted.repartition(6, "f2"), F4, "id", **settings)
    assert np.allclose(a.weights, b.weights, rtol=1e-10)


def test_early_stopping(spark, planted):
    settings = dict(hidden_neurons=[2, 2], epochs=30, validation_split=0.3, optimizer="sgd")
    short = autoencoder.fit_network(planted, F4, "id", early_stopping=1, **settings)
    full = autoencoder.fit_network(planted, F4, "id", early_stopping=True, **{**settings, "epochs": 4})
    assert 1 <= len(short.losses) <= 30 and len(full.losses) == 4


def test_validation_rows_by_order(spark, planted):
    model = autoencoder.fit_network(
        planted, F4, "id", hidden_neurons=[2, 2], epochs=1, validation_split=0.2, order_col="id"
    )
    assert len(model.losses) == 1


def test_bad_network_arguments(spark, planted):
    cases = {
        "both ways": dict(hidden_neurons=[4, 2, 3]),
        "neurons": dict(hidden_neurons=[8, 8]),
        "activation": dict(hidden_neurons=[2, 2], activation="swish"),
        "initializer": dict(hidden_neurons=[2, 2], kernel_initializer="magic"),
        "optimizer": dict(hidden_neurons=[2, 2], optimizer="lion"),
        "loss": dict(hidden_neurons=[2, 2], loss_function="huber"),
        "dropout": dict(hidden_neurons=[2, 2], dropout_rate=1.0),
    }
    for message, settings in cases.items():
        with pytest.raises(ValueError, match=message):
            autoencoder.fit_autoencoder(planted, F4, "id", **settings)
    # The default layers need at least 16 features.
    with pytest.raises(ValueError, match="neurons"):
        autoencoder.fit_autoencoder(planted, F4, "id")


@pytest.mark.parametrize("copies", [3, 4000])
def test_landmarks_do_not_depend_on_repeats(spark, copies):
    rows = spark.range(20 * copies).select((F.col("id") % 20).cast("double").alias("a"))
    found, times = svm.hashed_rows(rows, ["a"], 20 * copies, 256, 0)
    assert sorted(found[:, 0]) == list(range(20)) and set(times) == {copies}
    few, _ = svm.hashed_rows(rows, ["a"], 20 * copies, 5, 0)
    assert (few == found[:5]).all()


def test_samples_reach_the_whole_table(spark):
    rows = spark.range(0, 200_000, 1, 8).select(F.col("id").cast("double").alias("a"))
    found, _ = svm.hashed_rows(rows, ["a"], 200_000, 1000, 0)
    share = np.histogram(found[:, 0], 8, (0, 200_000))[0] / 1000
    assert len(found) == 1000 and (np.abs(share - 0.125) < 0.05).all()


def test_unfinished_fits_are_reported(spark, planted):
    with pytest.warns(UserWarning, match="did not reach"):
        assert not svm.fit_one_class_svm(planted, F4, 0.1, tol=1e-9, max_iter=1).converged
    with pytest.warns(UserWarning, match="did not converge"):
        assert not kmeans.fit_kmeans(planted, F4, 8, max_iter=1).converged
    assert kmeans.fit_kmeans(planted, F4, 3, n_init=2).converged


def test_bootstrap_draws_from_the_whole_table(spark):
    rows = spark.range(20_000)
    drawn = forest._draw(rows, ["id"], ["id"], 20_000, 20, 256, 0).groupBy("tree").count().collect()
    assert len(drawn) == 20 and min(r["count"] for r in drawn) >= 256
    matrix, rng = np.arange(256.0)[:, None], np.random.default_rng(0)
    for n, distinct in ((256, 162), (20_000, 254), (10**9, 256)):
        found = [forest._with_replacement(matrix, n, 256, rng) for _ in range(50)]
        assert {len(f) for f in found} == {256}
        assert abs(np.mean([len(np.unique(f)) for f in found]) - distinct) < 3


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_order_by_time(spark, kind):
    day = F.make_date(F.lit(2024), F.lit(1), F.lit(1))
    rows = spark.range(28).select("id", F.date_add(day, F.col("id").cast("int")).cast(kind).alias("at"))
    places = rows.select("id", autoencoder._place(rows, "at").alias("p")).orderBy("id").toPandas()["p"]
    assert np.allclose(np.diff(places), 86_400e6)
