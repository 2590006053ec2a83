"""Every row of the table is in one batch of the asked size in every epoch, and every batch makes a step."""

from __future__ import annotations

import inspect
import re

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

import __spark_entry__ as catalogue
from strayrow.functions.network import Network, Optimizer
from strayrow.operators import autoencoder

F4 = [f"f{i}" for i in range(4)]


def test_steps_are_those_of_plain_descent(spark, planted):
    settings = dict(hidden_neurons=[3, 2, 3], epochs=2, dropout_rate=0.0, optimizer="sgd", validation_split=0.0)
    model = autoencoder.fit_network(planted, F4, "id", **settings)
    x = np.array(sorted(planted.toPandas()[F4].to_numpy().tolist()))
    network = Network((4, 3, 2, 3, 4), "elu")
    weights = network.initial("glorot_uniform", 0)
    for epoch in range(2):
        order = np.random.default_rng([0, epoch, 0]).permutation(len(x))
        losses = []
        for start in range(0, len(x), 10):
            loss, grad = network.gradient(weights, x[order[start : start + 10]])
            weights = weights - 0.01 * grad
            losses.append(loss)
        assert len(losses) == 62
    assert np.allclose(model.weights, weights, rtol=1e-9)


def test_batches_hold_every_row_once():
    rng = np.random.default_rng(1)
    for copies in (np.ones(95), rng.integers(1, 11, 200).astype(float)):
        places = autoencoder._batches(copies, 10, rng)
        inside = places[places >= 0]
        assert sorted(inside) == list(range(len(copies)))
        assert len(places) in (int(np.ceil(copies.sum() / 10)), int(np.ceil(copies.sum() / 10)) - 1)
    assert sorted((places >= 0).sum(axis=1))[-1] <= 10


def test_replicas_computed_together_equal_single_ones():
    rng = np.random.default_rng(2)
    x, network, rule = rng.standard_normal((75, 4)), Network((4, 3, 4), "tanh", l2=0.1), Optimizer("adam")
    memory, counters = rule.initial(network.n_parameters)
    weights = network.initial("glorot_uniform", 0)
    state = np.concatenate([weights, memory.ravel(), counters])
    found = autoencoder._train(x, np.ones(75), np.random.default_rng(3), network, rule, state, 10, 3)
    places = autoencoder._batches(np.ones(75), 10, np.random.default_rng(3))
    total = np.zeros(len(state))
    for lane in range(3):
        w, m, c = weights.copy(), memory.copy(), counters.copy()
        rows = 0
        for at in places[lane::3]:
            at = at[at >= 0]
            rule.step(w, network.gradient(w, x[at])[1], m, c)
            rows += len(at)
        total += rows * np.concatenate([w, m.ravel(), c])
    assert found[0] == 75 and np.allclose(found[2:], total)


def test_many_replicas_learn_and_do_not_depend_on_partitions(spark, planted, monkeypatch):
    settings = dict(hidden_neurons=[3, 2, 3], epochs=8, dropout_rate=0.1)
    one = autoencoder.fit_network(planted, F4, "id", **settings)
    monkeypatch.setattr(autoencoder, "ROUND_STEPS", 8)
    monkeypatch.setattr(autoencoder, "LEAST_UNITS", 2)
    assert autoencoder._replicas(612, 10) == (2, 4)
    a = autoencoder.fit_network(planted.repartition(1), F4, "id", **settings)
    b = autoencoder.fit_network(planted.repartition(7, "f1"), F4, "id", **settings)
    assert np.array_equal(a.weights, b.weights) and a.losses == b.losses
    assert a.losses[-1] < a.losses[0] and one.losses[-1] < one.losses[0]


def test_copies_of_a_row_are_rows_of_several_batches(spark, monkeypatch):
    rows = spark.range(300).select(
        F.lit(None).cast("long").alias("id"), F.lit(1.0).alias("f0"), (F.col("id") % 2).cast("double").alias("f1")
    )
    settings = dict(hidden_neurons=[2, 2], epochs=1, dropout_rate=0.0, optimizer="sgd", validation_split=0.0)
    many = autoencoder.fit_network(rows, ["f0", "f1"], "id", **settings)
    big = autoencoder.fit_network(rows, ["f0", "f1"], "id", **{**settings, "batch_size": 4000})
    start = Network((2, 2, 2, 2), "elu").initial("glorot_uniform", 0)
    # thirty steps of about the same length, not one
    assert np.abs(many.weights - start).sum() > 10 * np.abs(big.weights - start).sum()


def test_the_query_trains_as_long_as_the_detector_asks():
    source = inspect.getsource(catalogue.flag_eight)
    assert not re.search("epochs|batch_size|early_stopping", source)


@pytest.mark.parametrize("n, batch_size", [(20_000, 10), (1_200_000, 10), (7_200_000, 10), (10**6, 4096)])
def test_work_units_are_bounded(n, batch_size):
    count, lanes = autoencoder._replicas(n, batch_size)
    assert n <= count * lanes * min(256 * batch_size, 65_536) and n / count <= 65_536
