"""Neighbours of wide points by codes, and of many points by a tree of pivots."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F
from test_neighbours import ORDERS, brute, crowded, lists

from strayrow.functions import distance
from strayrow.functions.distance import pairwise
from strayrow.operators import ball_tree, leading_axes
from strayrow.operators import neighbours as nn


def lying_flat(rng, n, width=64, inner=3, noise=1e-3):
    """Wide points close to a plane of few dimensions, a third of them copies and near copies."""
    plane = np.linalg.qr(rng.standard_normal((width, inner)))[0]
    x = 5 * rng.standard_normal((n, inner)) @ plane.T + noise * rng.standard_normal((n, width))
    x[: n // 6] = x[0]
    x[n // 6 : n // 3] = x[0] + noise * rng.standard_normal((n // 3 - n // 6, width))
    return x[rng.permutation(n)]


def names(width):
    return [f"f{i}" for i in range(width)]


@pytest.mark.parametrize("metric", ORDERS)
def test_codes_find_the_same_neighbours(spark, metric):
    rng = np.random.default_rng(1)
    x, new = lying_flat(rng, 400, 30), lying_flat(rng, 90, 30)
    x[200:240] = rng.standard_normal((40, 30)) * 3  # off the plane
    new[:20] = x[200:220] + 0.01
    index = nn.build_index(table(spark, x), names(30), "id", metric, cell_points=30, block_rows=25)
    own = nn.per_row(table(spark, x), "id", index, nn.self_neighbours(index, 7, "axes"))
    assert np.allclose(lists(own), brute(x, x, ORDERS[metric], 7, True), atol=1e-9)
    other = nn.neighbours(table(spark, new), "id", index, 7, "axes")
    assert np.allclose(lists(other), brute(new, x, ORDERS[metric], 7), atol=1e-9)


def test_cells_of_codes_smaller_than_k(spark):
    x = np.random.default_rng(2).standard_normal((70, 26))
    index = nn.build_index(table(spark, x), names(26), "id", cell_points=4)
    own = nn.per_row(table(spark, x), "id", index, nn.self_neighbours(index, 11, "axes"))
    assert np.allclose(lists(own), brute(x, x, 2.0, 11, True))


def test_equal_codes_of_different_points(spark):
    # all variance of the sample lies in one axis; the rest differs in direction only
    rng = np.random.default_rng(3)
    x = np.zeros((200, 24))
    x[:, 0] = np.repeat(np.arange(10.0), 20) * 100
    x[np.arange(200), 1 + np.arange(200) % 20] = 1.0
    x[150:, 0] = 5000 + rng.random(50)
    index = nn.build_index(table(spark, x), names(24), "id", cell_points=10, block_rows=8)
    own = nn.per_row(table(spark, x), "id", index, nn.self_neighbours(index, 5, "axes"))
    assert np.allclose(lists(own), brute(x, x, 2.0, 5, True))


def test_whole_vectors_visit_few_blocks(spark):
    rng = np.random.default_rng(4)
    x = lying_flat(rng, 3000, 64)
    index = nn.build_index(table(spark, x), names(64), "id", cell_points=40)
    codes, axes = nn._code_index(index)
    assert axes.width <= 5  # the plane and the rest
    placed = nn._cell_table(codes)["placed"]
    home = placed.withColumnRenamed("pid", "qid").select("qid", "f", "full", "reach", "block")
    whole = home.select("qid", F.col("full").alias("f"), F.lit(float("inf")).alias("bound"), "block")
    points = placed.select("pid", F.col("full").alias("f"), "w", "block")
    first = nn._ask_blocks(whole, points, nn.replace(index, cells=codes.cells), 5, True)
    visits = nn._code_visits(home, first, index, 5, True)
    blocks = codes.cells["blocks"]
    assert blocks > 50 and visits.count() / index.n_points < 8


@pytest.mark.parametrize("order", [1.0, 1.5, 2.0, 3.0, np.inf])
def test_code_distances_bound_the_distances(order):
    rng = np.random.default_rng(5)
    x = lying_flat(rng, 120, 40, 6, 0.5) + 1e4
    axes = leading_axes.choose_axes(x[:50], order)
    code = axes.code(x)
    short, exact = pairwise(code, code, 2.0), pairwise(x, x, order)
    assert (axes.least(short) <= exact + 1e-7).all()
    assert (exact <= axes.most(short, code[:, -1:], code[:, -1]) + 1e-7).all()
    assert np.allclose(axes.code_bound(axes.least(short)), short)


def test_wide_points_are_searched_by_codes_if_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(nn, "BROADCAST_POINTS", 10)
    x = np.random.default_rng(6).standard_normal((40, nn.WIDE))
    wide = nn.build_index(table(spark, x), names(nn.WIDE), "id")
    narrow = nn.build_index(table(spark, x[:, :3]), names(3), "id")
    assert nn.chosen_method(wide, "auto") == "axes" and nn.chosen_method(narrow, "auto") == "pivot"


@pytest.mark.parametrize("metric", ORDERS)
def test_tree_finds_the_same_neighbours(spark, monkeypatch, metric):
    monkeypatch.setattr(nn, "MAX_PIVOTS", 8)
    rng = np.random.default_rng(7)
    x, new = crowded(rng, 700), crowded(rng, 150)
    index = nn.build_index(table(spark, x), names(3), "id", metric, cell_points=6, block_rows=10)
    own = nn.per_row(table(spark, x), "id", index, nn.self_neighbours(index, 7, "pivot"))
    assert len(index.cells["tree"].levels) >= 2
    assert np.allclose(lists(own), brute(x, x, ORDERS[metric], 7, True), atol=1e-12)
    other = nn.neighbours(table(spark, new), "id", index, 7, "pivot")
    assert np.allclose(lists(other), brute(new, x, ORDERS[metric], 7), atol=1e-12)


def test_leaves_of_the_tree_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(nn, "MAX_PIVOTS", 8)
    rng = np.random.default_rng(8)
    x = np.vstack([rng.random((3000, 2)), 1e-6 * rng.random((1000, 2))])
    index = nn.build_index(table(spark, x), names(2), "id", cell_points=25)
    cells = nn._cell_table(index)
    sizes = ball_tree.leaf_sizes(cells["tree"])
    assert sizes.agg(F.max("n")).first()[0] <= 50
    placed = cells["placed"]
    assert placed.count() == placed.select("pid").distinct().count() == 4000
    # rows within a small bound ask few of the leaves
    home = placed.select(F.col("pid").alias("qid"), "f", "reach", F.lit(0.02).alias("bound"), F.col("block").alias("home"))
    assert nn._reachable(home, index, 6).count() / 4000 < 0.2 * sizes.count()


def test_ranges_of_nodes_hold_their_points(spark, monkeypatch):
    monkeypatch.setattr(nn, "MAX_PIVOTS", 4)
    x = np.random.default_rng(9).standard_normal((600, 2))
    index = nn.build_index(table(spark, x), names(2), "id", cell_points=8)
    tree = nn._cell_table(index)["tree"]
    numbers = set()
    for children in tree.levels:
        rows = children.collect()
        assert len({r["parent"] for r in rows}) < len(rows)
        for r in rows:
            assert r["node"] not in numbers and 0 == r["low"] <= r["high"]
            numbers.add(r["node"])
    inner = {r["node"] for c in tree.levels for r in c.where("inner").collect()}
    assert not inner & {r["node"] for r in ball_tree.leaf_sizes(tree).collect()}


def test_codes_and_tree_together(spark, monkeypatch):
    monkeypatch.setattr(nn, "MAX_PIVOTS", 8)
    rng = np.random.default_rng(10)
    x, new = lying_flat(rng, 500, 32), lying_flat(rng, 60, 32)
    index = nn.build_index(table(spark, x), names(32), "id", cell_points=8, block_rows=16)
    own = nn.per_row(table(spark, x), "id", index, nn.self_neighbours(index, 6, "axes"))
    assert index.cells["codes"].cells["tree"] is not None
    assert np.allclose(lists(own), brute(x, x, 2.0, 6, True), atol=1e-9)
    other = nn.neighbours(table(spark, new), "id", index, 6, "axes")
    assert np.allclose(lists(other), brute(new, x, 2.0, 6), atol=1e-9)


def test_rows_move_once_for_a_group_of_cells(spark, monkeypatch):
    # nothing can be excluded here; with 100 cells a row was sent to each of them
    x = np.random.default_rng(8).standard_normal((400, 26))
    kept = {}
    store = nn.materialize
    monkeypatch.setattr(nn, "materialize", lambda df, label: kept.setdefault(label, store(df, label)))
    index = nn.build_index(table(spark, x), names(26), "id", cell_points=4)
    own = nn.per_row(table(spark, x), "id", index, nn.self_neighbours(index, 5, "axes"))
    assert np.allclose(lists(own), brute(x, x, 2.0, 5, True))
    assert kept["asking-more"].agg(F.max(F.size("blocks"))).first()[0] == 1


@pytest.mark.parametrize("order", [1.0, 2.0, 2.5, 3.0, float("inf")])
def test_screened_search_is_the_plain_one(order, monkeypatch):
    rng = np.random.default_rng(9)
    x, copies = rng.standard_normal((2600, 24)), rng.integers(1, 4, 2600)
    x[100:200], x[300:500] = x[0], np.round(x[300:500])
    measured = []
    exact = distance.row_by_row
    monkeypatch.setattr(distance, "row_by_row", lambda a, b, order: measured.append(len(a)) or exact(a, b, order))
    cases = [(x, np.inf), (x + 1e6, np.inf), (x * 1e-8 + 5, np.inf), (x * 1e20, np.inf), (np.round(x), 4.0)]
    for y, limit in cases:
        asked = (y[:300], y, copies, 7, order, True, np.full(300, limit))
        measured.clear()
        found = distance.nearest(*asked)
        if y is x:  # few pairs of the 780,000 are measured in full
            assert 0 < sum(measured) < 100_000
        with monkeypatch.context() as m:
            m.setattr(distance, "CELL_SEARCH_POINTS", 10**9)
            plain = distance.nearest(*asked)
        assert all(np.array_equal(a, b) for a, b in zip(found, plain))
