"""Statistics, sketches and stored versions that later data is merged into."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from strayrow.operators import pca, score_sketch, stats
from strayrow.plans import versions
from strayrow.plans.pipeline import FittedPipeline, Pipeline
from strayrow.session import new_path

F4 = [f"f{i}" for i in range(4)]


def wide(n=700, width=20, seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, width)) @ rng.standard_normal((width, width)) + 1e6 * np.arange(width)


def names(width):
    return [f"f{i}" for i in range(width)]


def close(a, b):
    assert a.n == b.n
    for name in ("low", "high", "mean", "var", "cov"):
        x, y = getattr(a, name), getattr(b, name)
        assert (x is None) == (y is None)
        assert x is None or np.allclose(x, y, rtol=1e-9, atol=1e-9 * np.abs(y).max())


@pytest.mark.parametrize("with_cov", [False, True])
@pytest.mark.parametrize("partitions", [1, 9, 150])
def test_blocks_of_moments(spark, monkeypatch, with_cov, partitions):
    monkeypatch.setattr(stats, "MOST_BLOCKS", 5)
    x = wide()
    found = stats.collect_stats(table(spark, x).repartition(partitions), names(20), with_cov)
    assert found.n == 700
    assert np.array_equal(found.low, x.min(axis=0)) and np.array_equal(found.high, x.max(axis=0))
    assert np.allclose(found.mean, x.mean(axis=0), rtol=1e-14) and np.allclose(found.var, x.var(axis=0), rtol=1e-9)
    if with_cov:
        assert np.allclose(found.cov, np.cov(x.T), rtol=1e-8, atol=1e-8)
    else:
        assert found.cov is None


@pytest.mark.parametrize("width", [3, 20])
@pytest.mark.parametrize("with_cov", [False, True])
def test_merge_of_parts_equals_the_whole(spark, width, with_cov):
    x = wide(600, width, 1)
    df = table(spark, x)
    whole = stats.collect_stats(df, names(width), with_cov)
    parts = [stats.collect_stats(df.where(f"id % 3 = {k}"), names(width), with_cov) for k in range(3)]
    close(parts[0].merge(parts[1]).merge(parts[2]), whole)
    close(parts[2].merge(parts[0].merge(parts[1])), whole)
    one = stats.collect_stats(df.where("id = 5"), names(width), with_cov)
    rest = stats.collect_stats(df.where("id <> 5"), names(width), with_cov)
    close(one.merge(rest), whole)


def test_axes_of_merged_statistics(spark):
    x = wide(500, 20, 2)
    df = table(spark, x)
    parts = [stats.collect_stats(df.where(f"id < 200 = {k}"), names(20), True) for k in ("true", "false")]
    a = pca.projection_from_stats(parts[0].merge(parts[1]), names(20), 0.8)
    b = pca.fit_pca(df, names(20), 0.8)
    assert a.axes.shape == b.axes.shape and np.allclose(np.abs(a.axes), np.abs(b.axes), atol=1e-6)


def test_a_sketch_moves_with_later_scores(spark):
    rng = np.random.default_rng(3)
    first, later = rng.standard_normal(30_000), 3 + rng.standard_normal(20_000)
    sets = [table(spark, x[:, None], ["s"]).repartition(6) for x in (first, later)]
    sketches = [score_sketch.sketch_scores(d, "s") for d in sets]
    both = score_sketch.merged(spark, sketches)
    every = np.sort(np.r_[first, later])
    assert both.n == 50_000 and [s.n for s in sketches] == [30_000, 20_000]
    for share in (0.5, 0.1, 0.01):
        cut = score_sketch.cut(spark, both, share)
        assert abs((every > cut).sum() - share * 50_000) <= 2 * both.rank_error
    days = sets[0].union(sets[1]).groupBy((F.col("id") % 20).alias("day")).agg(score_sketch.sketch_column(F.col("s")).alias("k"))
    daily = score_sketch.merged_column(days, "k")
    assert daily.n == 50_000
    assert abs((every > score_sketch.cut(spark, daily, 0.1)).sum() - 5_000) <= 2 * daily.rank_error


def test_sketch_of_few_none_and_odd_scores(spark):
    some = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),), (float("inf"),)], "s double")
    found = score_sketch.sketch_scores(some, "s")
    assert found.n == 3 and found.rank_error == 0 and score_sketch.cut(spark, found, 0.5) in (1.0, 2.0)
    none = score_sketch.sketch_scores(some.limit(0), "s")
    assert none.n == 0
    with pytest.raises(ValueError, match="cut"):
        score_sketch.cut(spark, none, 0.1)
    with pytest.raises(ValueError, match="merge"):
        score_sketch.merged(spark, [])
    assert score_sketch.merged(spark, [found, none]).n == 3


def small(df, scaler="minmax", k=2):
    return Pipeline(scaler).add("pca_mahalanobis").add("local_outlier_factor", n_neighbors=k).fit(df, F4, "id")


def flags(fitted, df):
    return fitted.flag(df).orderBy("id").toPandas()


def test_a_model_is_replaced_and_old_readers_go_on(spark, planted):
    path = new_path(spark, "model")
    with pytest.raises(FileNotFoundError):
        versions.load_newest(spark, path)
    first = versions.save_version(spark, small(planted), path, "m")
    reader = versions.load_newest(spark, path)
    before = flags(reader, planted)
    second = versions.save_version(spark, small(planted, "standard", 9), path, "m")
    assert second["number"] == 2 and versions.metadata(spark, path)["updated"] >= first["updated"]
    stored = versions.metadata(spark, path)
    assert stored["created"] == versions.versions(spark, path)[0]["created"] and stored["model_id"] == "m"
    assert versions.load_newest(spark, path).scaler.kind == "standard"
    assert flags(reader, planted).equals(before)
    with pytest.raises(ValueError, match="holds the model m"):
        versions.save_version(spark, small(planted), path, "other")
    assert versions.prune(spark, path) == 1
    assert len(flags(versions.load_newest(spark, path), planted)) == 612
    assert versions.save_version(spark, small(planted), path, "m")["created"] == stored["created"]


def test_a_failed_save_leaves_the_old_model(spark, planted, monkeypatch):
    path = new_path(spark, "model")
    fitted = small(planted)
    versions.save_version(spark, fitted, path, "m")
    before = flags(versions.load_newest(spark, path), planted)
    from strayrow.sources import state

    def fail(*args, **kwargs):
        raise OSError("disk full")

    monkeypatch.setattr(state, "write_metadata", fail)
    with pytest.raises(OSError, match="disk full"):
        versions.save_version(spark, small(planted, "standard"), path, "m")
    monkeypatch.undo()
    assert len(versions.versions(spark, path)) == 1
    assert flags(versions.load_newest(spark, path), planted).equals(before)
    assert versions.save_version(spark, fitted, path, "m")["number"] == 2


def test_pipelines_saved_without_versions_are_still_read(spark, planted):
    path = new_path(spark, "model")
    fitted = small(planted)
    fitted.save(spark, path, "m")
    assert flags(versions.load_newest(spark, path), planted).equals(flags(FittedPipeline.load(spark, path), planted))
    with pytest.raises(ValueError, match="at least one"):
        versions.prune(spark, path, 0)
