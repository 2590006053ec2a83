"""Neighbour searches and the outlier factor leave nothing behind but what is read later, and move bounded slices."""

from __future__ import annotations

import os

import numpy as np
import pytest
from conftest import by_id, table
from pyspark.sql import functions as F

import __spark_entry__ as catalogue
from strayrow import session
from strayrow.operators import lof, neighbours

F3 = ["f0", "f1", "f2"]


@pytest.fixture
def cloud(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "NARROW_CELL_POINTS", 64)
    x = np.random.default_rng(5).standard_normal((700, 3))
    x[:60] = x[60:120]
    return table(spark, x)


def stored(spark) -> set[str]:
    folder = session.shared_dir(spark) + "/strayrow"
    return {f for f in os.listdir(folder)} if os.path.isdir(folder) else set()


def test_only_tables_that_are_read_later_are_kept(spark, cloud):
    before = stored(spark)
    model = lof.fit_lof(cloud, F3, "id", 5, method="pivot")
    kept = sorted(f.rsplit("-", 1)[0] for f in stored(spark) - before)
    assert kept == ["cells", "lof-points", "points"]
    flags = model.flag(cloud, "id")
    kept = sorted(f.rsplit("-", 1)[0] for f in stored(spark) - before)
    assert kept == ["cells", "distinct", "found", "lof-points", "points", "rows"]
    assert flags.count() == 700


def test_slices_have_the_scores_of_the_whole(spark, cloud, monkeypatch):
    whole = lof.fit_lof(cloud, F3, "id", 5, method="pivot")
    scores = by_id(whole.flag(cloud, "id"), "score")
    monkeypatch.setattr(neighbours, "SLICE_ROWS", 200)
    monkeypatch.setattr(lof, "SLICE_POINTS", 150)
    before = stored(spark)
    sliced = lof.fit_lof(cloud, F3, "id", 5, method="pivot")
    assert sliced.threshold == pytest.approx(whole.threshold)
    assert np.allclose(by_id(sliced.flag(cloud, "id"), "score"), scores)
    assert np.allclose(by_id(sliced.training_scores(cloud, "id"), "score"), by_id(whole.training_scores(cloud, "id"), "score"))
    assert sum(f.startswith("found-") for f in stored(spark) - before) == 4
    plain = by_id(lof.fit_lof(cloud, F3, "id", 5, method="broadcast").flag(cloud, "id"), "score")
    assert np.allclose(scores, plain)


def test_a_shared_graph_is_kept(spark, cloud):
    graph = neighbours.build_graph(cloud, F3, "id", 8, method="pivot")
    model = lof.fit_lof(cloud, F3, "id", 5, method="pivot", graph=graph)
    assert graph.nearest(8).count() == model.index.n_points == 640


def test_shuffles_of_stored_tables_are_deleted(spark, monkeypatch):
    seen = []
    conf = session.SHUFFLE_CLEANUP_CONF
    before = spark.conf.get(conf)
    path = session.new_path
    with session.short_shuffles(spark):
        with session.short_shuffles(spark):
            seen.append(spark.conf.get(conf))
        seen.append(spark.conf.get(conf))
    assert seen == ["true", "true"] and spark.conf.get(conf) == before
    during = []
    writer = type(spark.range(1).write)
    write = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, *a, **k: during.append(spark.conf.get(conf)) or write(self, *a, **k))
    rows = spark.range(5000).repartition(4, "id")
    found = session.materialize(rows, "some")
    assert during == ["true"] and spark.conf.get(conf) == before and path(spark, "x")
    # a table whose shuffle is gone can be read again
    assert found.count() == rows.count() == rows.groupBy(F.col("id") % 7).count().agg(F.sum("count")).first()[0] == 5000


def test_averages_by_slices_are_those_of_the_whole(spark, tmp_path, monkeypatch):
    lines = spark.range(900).select(
        F.when(F.col("id") % 50 != 0, F.col("id") % 211).alias("l_orderkey"),
        *[(F.col("id") * i % 37).cast("double").alias(c) for i, c in enumerate(catalogue.LINE, 1)],
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    read = lambda df: sorted(tuple(map(str, r)) for r in df.select(*[F.round(c, 9) if c != "l_orderkey" else c for c in df.columns]).collect())
    whole = read(catalogue.order_averages(spark, str(tmp_path)))
    monkeypatch.setattr(catalogue, "SLICE_LINES", 300)
    before = stored(spark)
    assert read(catalogue.stored_order_averages(spark, str(tmp_path))) == whole
    assert len([f for f in stored(spark) - before if f.startswith("order-averages")]) == 3
