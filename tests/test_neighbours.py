from __future__ import annotations

import numpy as np
import pytest
from conftest import by_id, table
from pyspark.sql import functions as F

from strayrow.functions import distance
from strayrow.operators import knn, lof
from strayrow.operators import neighbours as nn

ORDERS = {"euclidean": 2.0, "manhattan": 1.0, "chebyshev": np.inf}


def brute(a, b, order, k, without_self=False):
    d = np.abs(a[:, None] - b[None])
    d = d.max(axis=2) if np.isinf(order) else (d**order).sum(axis=2) ** (1 / order)
    if without_self:
        np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


def crowded(rng, n=500, width=3):
    """A third of the rows are copies of one point, another third lies close to it."""
    x = rng.standard_normal((n, width)) * 4
    x[: n // 3] = 1.5
    third = n // 3
    x[third : 2 * third] = 1.5 + 1e-3 * rng.standard_normal((third, width))
    return x[rng.permutation(n)]


def lists(df):
    return np.array(by_id(df.select("id", nn.distances().alias("d")), "d").tolist())


@pytest.mark.parametrize("metric", ORDERS)
@pytest.mark.parametrize("method", ["broadcast", "pivot"])
def test_exact_on_crowded_points(spark, metric, method):
    rng = np.random.default_rng(1)
    x, new = crowded(rng), crowded(rng, 120)
    names = ["f0", "f1", "f2"]
    df, more = table(spark, x), table(spark, new)
    index = nn.build_index(df, names, "id", metric, cell_points=40, block_rows=25)
    own = nn.per_row(df, "id", index, nn.self_neighbours(index, 7, method))
    assert np.allclose(lists(own), brute(x, x, ORDERS[metric], 7, True), atol=1e-12)
    other = nn.neighbours(more, "id", index, 7, method)
    assert np.allclose(lists(other), brute(new, x, ORDERS[metric], 7), atol=1e-12)


def test_cells_smaller_than_k(spark):
    x = np.random.default_rng(2).standard_normal((60, 2))
    index = nn.build_index(table(spark, x), ["f0", "f1"], "id", cell_points=4)
    own = nn.per_row(table(spark, x), "id", index, nn.self_neighbours(index, 11, "pivot"))
    assert np.allclose(lists(own), brute(x, x, 2.0, 11, True))


def test_only_reachable_blocks_are_asked(spark):
    rng = np.random.default_rng(3)
    x = rng.random((4000, 2))
    index = nn.build_index(table(spark, x), ["f0", "f1"], "id", cell_points=100)
    table_ = nn._cell_table(index)
    home = table_["placed"].select(
        F.col("pid").alias("qid"), "f", "reach", F.lit(0.05).alias("bound"), F.col("block").alias("home")
    )
    asked = nn._reachable(home, index, 6).count() / 4000
    assert asked < 0.2 * table_["first"][-1]


def test_cells_are_those_of_the_nearest_pivot(spark):
    rng = np.random.default_rng(13)
    x = np.vstack([rng.standard_normal((900, 2)), 40 * rng.standard_normal((100, 2))])
    for metric, order in ORDERS.items():
        index = nn.build_index(table(spark, x), ["f0", "f1"], "id", metric, cell_points=10)
        cells = nn._choose_cells(index)
        cell, reach = cells.assign(x)
        d = distance.pairwise(x, cells.pivots, order)
        assert np.array_equal(reach, d.min(axis=1))
        assert np.array_equal(d[np.arange(1000), cell], reach)


def test_wide_points_use_the_product_form(spark):
    x = np.random.default_rng(4).standard_normal((300, 20)) + 100.0
    names = [f"f{i}" for i in range(20)]
    index = nn.build_index(table(spark, x), names, "id")
    own = nn.per_row(table(spark, x), "id", index, nn.self_neighbours(index, 5))
    assert np.allclose(lists(own), brute(x, x, 2.0, 5, True))


def test_kernel_ties_limits_and_weights():
    points = np.array([[0.0], [1.0], [1.0001], [3.0]])
    w = np.array([1, 2, 1, 5])
    r, c, d = distance.nearest(np.array([[0.0]]), points, w, 4, 2.0)
    assert c.tolist() == [0, 1, 1, 2]
    r, c, d = distance.nearest(np.array([[1.0]]), points, w, 2, 2.0, exclude_self=True)
    assert c.tolist() == [1, 2]
    r, c, d = distance.nearest(np.array([[0.0]]), points, w, 4, 2.0, limit=np.array([1.0]))
    assert c.tolist() == [0, 1, 1]
    r, c, d = distance.nearest(np.zeros((0, 1)), points, w, 4, 2.0)
    assert len(r) == 0


@pytest.mark.parametrize("order", [1.0, 2.0, 3.0, np.inf])
@pytest.mark.parametrize("without_self", [False, True])
def test_search_in_cells_equals_the_plain_search(order, without_self, monkeypatch):
    rng = np.random.default_rng(12)
    points = np.unique(np.vstack([crowded(rng, 900, 2), rng.integers(0, 9, (80, 2))]), axis=0)
    w = rng.integers(1, 4, len(points))
    queries = points if without_self else np.vstack([crowded(rng, 200, 2), [[1e3, -1e3]]])
    limit = np.where(rng.random(len(queries)) < 0.3, 0.5, np.inf)
    found = []
    for size in (1, 10**9):
        monkeypatch.setattr(distance, "CELL_SEARCH_POINTS", size)
        found.append(distance.nearest(queries, points, w, 6, order, without_self, limit))
    for a, b in zip(*found):
        assert np.array_equal(a, b)


def test_metric_names():
    assert distance.metric_order("minkowski", 3) == 3.0
    assert distance.metric_order("chebyshev") == np.inf
    with pytest.raises(ValueError, match="metric"):
        distance.metric_order("cosine")
    with pytest.raises(ValueError, match="at least 1"):
        distance.metric_order("minkowski", 0.5)


def test_minkowski_of_third_order(spark):
    x = np.random.default_rng(5).standard_normal((80, 3))
    index = nn.build_index(table(spark, x), ["f0", "f1", "f2"], "id", "minkowski", 3, 20)
    own = nn.per_row(table(spark, x), "id", index, nn.self_neighbours(index, 4, "pivot"))
    assert np.allclose(lists(own), brute(x, x, 3.0, 4, True))


def test_bad_k_and_method(spark):
    index = nn.build_index(table(spark, np.arange(5.0)[:, None]), ["f0"], "id")
    with pytest.raises(ValueError, match="n_neighbors"):
        nn.self_neighbours(index, 5)
    with pytest.raises(ValueError, match="method"):
        nn.self_neighbours(index, 2, "tree")


@pytest.mark.parametrize("how", ["max_distance", "average", "median"])
def test_knn_detector(spark, planted, how):
    names = ["f0", "f1", "f2", "f3"]
    x = planted.orderBy("id").toPandas()[names].to_numpy()
    model = knn.fit_knn(planted, names, "id", n_neighbors=4, score_func=how)
    summary = {"max_distance": lambda d: d[:, -1], "average": lambda d: d.mean(1), "median": lambda d: np.median(d, 1)}[how]
    assert np.isclose(model.threshold, np.percentile(summary(brute(x, x, 2.0, 4, True)), 90))
    flags = model.flag(planted, "id")
    assert np.allclose(by_id(flags, "score"), summary(brute(x, x, 2.0, 4)))
    assert by_id(flags, "flag")[-12:].all()


def test_several_id_columns(spark, planted):
    df = planted.withColumns({"a": F.col("id") % 7, "b": F.expr("id div 7")})
    names = ["f0", "f1", "f2", "f3"]
    one = knn.fit_knn(df, names, "id")
    two = knn.fit_knn(df, names, ["a", "b"])
    assert one.threshold == two.threshold
    flags = two.flag(df, ["a", "b"])
    assert flags.columns == ["a", "b", "score", "flag"]
    assert flags.filter("flag").count() == one.flag(df, "id").filter("flag").count()


def brute_lof(x, new, k):
    """Factors of the training rows and of new rows, straight from the definition."""

    def rank(a, without_self):
        d = np.linalg.norm(a[:, None] - x[None], axis=2)
        if without_self:
            np.fill_diagonal(d, np.inf)
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(d, at, axis=1)

    at, d = rank(x, True)
    kd = d[:, -1]
    lrd = 1 / (np.maximum(kd[at], d).mean(1) + 1e-10)
    at_new, d_new = rank(new, False)
    lrd_new = 1 / (np.maximum(kd[at_new], d_new).mean(1) + 1e-10)
    return lrd[at].mean(1) / lrd, lrd[at_new].mean(1) / lrd_new


@pytest.mark.parametrize("method", ["broadcast", "pivot"])
def test_local_outlier_factor(spark, planted, method):
    names = ["f0", "f1", "f2", "f3"]
    x = planted.orderBy("id").toPandas()[names].to_numpy()
    model = lof.fit_lof(planted, names, "id", method=method)
    train, again = brute_lof(x, x, 20)
    assert np.allclose(by_id(model.training_scores(planted, "id"), "score"), train)
    assert np.isclose(model.threshold, np.percentile(train, 90))
    flags = model.flag(planted, "id")
    assert np.allclose(by_id(flags, "score"), again)
    assert by_id(flags, "flag")[-12:].mean() > 0.5


def test_copies_do_not_divide_by_zero(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([np.zeros((40, 2)), rng.standard_normal((60, 2)) + 5])
    model = lof.fit_lof(table(spark, x), ["f0", "f1"], "id", n_neighbors=5)
    scores = by_id(model.training_scores(table(spark, x), "id"), "score")
    assert np.isfinite(scores).all()
    assert np.allclose(scores[:40], 1.0)


def test_neighbourhood_is_cut_to_the_table(spark):
    x = np.random.default_rng(10).standard_normal((8, 2))
    assert lof.fit_lof(table(spark, x), ["f0", "f1"], "id").n_neighbors == 7


def test_rows_that_share_an_id_keep_their_own_factor(spark):
    x = np.random.default_rng(3).standard_normal((60, 2))
    model = lof.fit_lof(table(spark, x), ["f0", "f1"], "id", 5)
    points = [(7, 0.0, 0.0), (7, 5.0, 5.0), (8, 1.0, 0.0), (7, 0.0, 0.0)]
    new = spark.createDataFrame(points, "id long, f0 double, f1 double")
    alone = spark.createDataFrame([(i, *p[1:]) for i, p in enumerate(points)], new.schema)
    got = sorted(r["score"] for r in model.flag(new, "id").collect())
    assert np.allclose(got, sorted(by_id(model.flag(alone, "id"), "score")), rtol=1e-12)
    assert [r["id"] for r in model.flag(new, "id").orderBy("id").collect()] == [7, 7, 7, 8]


def test_a_large_block_is_not_compared_whole(monkeypatch):
    rng = np.random.default_rng(21)
    x = rng.standard_normal((16_384, 4))
    x[:4000] = np.round(x[:4000], 1)
    x = np.unique(x, axis=0)
    asked = rng.permutation(len(x))[:4000]
    compared = []
    exact = distance.pairwise
    monkeypatch.setattr(distance, "pairwise", lambda a, b, order: compared.append(len(a) * len(b)) or exact(a, b, order))
    rows, cols, d = distance.nearest(x[asked], x, np.ones(len(x), dtype=np.int64), 20, 2.0, True)
    assert sum(compared) < 8000 * len(asked)
    some = np.arange(0, len(asked), 40)
    assert np.allclose(d.reshape(-1, 20)[some], brute(x[asked[some]], x, 2.0, 21)[:, 1:], atol=1e-12)


def test_copies_of_a_row_are_scored_once(spark, monkeypatch):
    x = np.random.default_rng(22).standard_normal((60, 2))
    df = table(spark, np.repeat(x, 10, axis=0))
    model = lof.fit_lof(df, ["f0", "f1"], "id", 20, method="pivot")
    given = []
    score = lof.LocalOutlierFactor.add_score
    monkeypatch.setattr(
        lof.LocalOutlierFactor, "add_score", lambda self, found, *names: given.append(found.count()) or score(self, found, *names)
    )
    scores = by_id(model.score(df, "id"), "score").reshape(60, 10)
    assert given == [60]
    everywhere = by_id(lof.fit_lof(df, ["f0", "f1"], "id", 20).score(df, "id"), "score").reshape(60, 10)
    assert np.allclose(scores, everywhere)
