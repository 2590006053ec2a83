from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
from conftest import by_id, table
from pyspark.sql import functions as F

from strayrow.operators import knn, lof, neighbours, pca
from strayrow.operators.base import NotTrainedError
from strayrow.plans.detectors import DETECTORS
from strayrow.plans.pipeline import FittedPipeline, Pipeline, load_detector, save_detector
from strayrow.session import new_path
from strayrow.sources import predictions
from strayrow.streaming import scoring

SENSORS = ["bearing1", "bearing2", "bearing3", "bearing4"]


def eight() -> Pipeline:
    return (
        Pipeline()
        .add("pca_mahalanobis")
        .add("autoencoder", hidden_neurons=[4, 2, 2, 4], l1=0.0, epochs=2)
        .add("kmeans", max_cluster_elbow=5)
        .add("one_class_svm")
        .add("gaussian_distribution")
        .add("isolation_forest", n_estimators=20)
        .add("knearest_neighbors")
        .add("local_outlier_factor")
    )


@pytest.fixture(scope="module")
def fitted(bearings):
    return eight().fit(bearings, SENSORS, "id")


@pytest.fixture(scope="module")
def flags(fitted, bearings):
    return fitted.flag(bearings).toPandas().sort_values("id", ignore_index=True)


def test_unknown_names(bearings):
    with pytest.raises(KeyError, match="foo"):
        Pipeline().add("foo")
    with pytest.raises(TypeError, match="colour"):
        Pipeline().add("kmeans", colour=3)
    with pytest.raises(ValueError, match="scaler"):
        Pipeline("robust")
    with pytest.raises(ValueError, match="contamination"):
        Pipeline().add("pca_mahalanobis", contamination=2.0).fit(bearings, SENSORS, "id")
    with pytest.raises(ValueError, match="add a detector"):
        Pipeline().fit(bearings, SENSORS, "id")


def test_every_detector_has_its_settings():
    assert len(DETECTORS) == 8
    settings = {k: d.settings({}) for k, d in DETECTORS.items()}
    assert settings["pca_mahalanobis"] == {"n_components": 2, "contamination": 0.1}
    assert settings["gaussian_distribution"] == {"epsilon_candidates": 100_000_000}
    assert settings["autoencoder"]["epochs"] == 100 and settings["autoencoder"]["batch_size"] == 10
    assert settings["local_outlier_factor"]["n_neighbors"] == 20
    assert settings["knearest_neighbors"]["n_neighbors"] == 5


def test_not_trained(bearings):
    with pytest.raises(NotTrainedError):
        eight().flag(bearings)


def test_one_flag_per_row_and_detector(flags, bearings):
    assert list(flags.columns) == ["id", *eight().specs]
    assert len(flags) == 222
    assert all(flags[k].dtype == bool for k in eight().specs)


def test_training_share(flags):
    for key in ("pca_mahalanobis", "autoencoder", "kmeans", "isolation_forest"):
        assert flags[key].mean() <= 0.1 + 1 / 222
    assert abs(flags["one_class_svm"].mean() - 0.1) <= 0.02
    assert flags["gaussian_distribution"].sum() == 1


def test_anomalies_are_found_by_all(fitted, spark, bearings):
    far = bearings.limit(4).select("id", *[(F.col(s) + 0.05).alias(s) for s in SENSORS])
    found = fitted.flag(far).toPandas()
    assert found[list(eight().specs)].all().all()


def test_long_output(fitted, flags, bearings):
    long = fitted.flag(bearings, "long").toPandas()
    assert len(long) == 8 * 222 and list(long.columns) == ["id", "detector", "score", "flag"]
    wide = long.pivot(index="id", columns="detector", values="flag").reset_index()
    pd.testing.assert_frame_equal(wide[flags.columns], flags, check_names=False, check_dtype=False)
    with pytest.raises(ValueError, match="output"):
        fitted.flag(bearings, "tall")


def test_pipeline_equals_single_fits(spark, planted):
    names = ["f0", "f1", "f2", "f3"]
    both = Pipeline("standard").add("pca_mahalanobis").add("knearest_neighbors").add("local_outlier_factor")
    model = both.fit(planted, names, "id")
    scaled = model.scaler.transform(planted)
    assert np.isclose(model.models["pca_mahalanobis"].threshold, pca.fit_pca_mahalanobis(scaled, names).threshold)
    assert np.isclose(model.models["knearest_neighbors"].threshold, knn.fit_knn(scaled, names, "id").threshold)
    assert np.isclose(model.models["local_outlier_factor"].threshold, lof.fit_lof(scaled, names, "id").threshold)


def test_every_fit_starts_anew(spark, bearings):
    pipeline = Pipeline().add("pca_mahalanobis")
    first = pipeline.fit(bearings, SENSORS, "id")
    doubled = bearings.select("id", *[(F.col(s) * 2).alias(s) for s in SENSORS])
    second = pipeline.fit(doubled, SENSORS, "id")
    assert np.allclose(second.scaler.shift, 2 * first.scaler.shift)
    assert np.isclose(first.models["pca_mahalanobis"].threshold, second.models["pca_mahalanobis"].threshold)


def test_labels_choose_the_gaussian_cut(spark, planted):
    names = ["f0", "f1", "f2", "f3"]
    model = Pipeline().add("gaussian_distribution", epsilon_candidates=1000).fit(
        planted, names, "id", label_col="y"
    )
    flags = by_id(model.flag(planted), "gaussian_distribution")
    assert flags[-12:].mean() > 0.9


def test_save_and_load(spark, fitted, flags, bearings):
    path = new_path(spark, "model")
    with pytest.raises(FileNotFoundError):
        FittedPipeline.load(spark, path)
    fitted.save(spark, path, "bearings")
    again = FittedPipeline.load(spark, path)
    assert {k: type(m) for k, m in again.models.items()} == {
        k: type(m) for k, m in fitted.models.items()
    }
    assert again.scaler.kind == "minmax" and again.features == tuple(SENSORS)
    result = again.flag(bearings).toPandas().sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(result, flags)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        fitted.save(spark, path, "bearings")


@pytest.mark.parametrize("key", list(eight().specs))
def test_single_detectors_are_stored(spark, fitted, bearings, key):
    path = new_path(spark, "detector")
    model = fitted.models[key]
    save_detector(spark, model, path, "one")
    again = load_detector(spark, path)
    scaled = fitted.scaler.transform(bearings)
    assert type(again) is type(model)
    a, b = (by_id(m.flag(scaled, "id"), "score") for m in (model, again))
    assert np.array_equal(a, b)


def test_missing_cells(spark, planted):
    names = ["f0", "f1", "f2", "f3"]
    gaps = planted.withColumn("f1", F.when(F.col("id") % 10 == 3, None).otherwise(F.col("f1")))
    pipeline = Pipeline().add("pca_mahalanobis").add("isolation_forest", n_estimators=5)
    pipeline.add("knearest_neighbors").add("local_outlier_factor")
    with pytest.raises(Exception, match="feature f1"):
        pipeline.fit(gaps, names, "id")
    model = pipeline.fit(gaps, names, "id", on_null="skip")
    found = model.flag(gaps, on_null="skip").toPandas().sort_values("id")
    missing = (found["id"] % 10 == 3).to_numpy()
    assert len(found) == 612
    for key in model.models:
        assert (found[key].isna().to_numpy() == missing).all()


def test_stream_equals_batch_and_replays(spark, fitted, flags, bearings):
    source, path, log = (new_path(spark, n) for n in ("arriving", "flags", "log"))
    bearings.repartition(3).write.parquet(source)
    arriving = spark.readStream.schema(bearings.schema).option("maxFilesPerTrigger", 1).parquet(source)
    scoring.write_stream(arriving, fitted, path, "bearings", log).awaitTermination()
    stored = predictions.read(spark, path, "bearings")
    assert stored.select("prediction_id").distinct().count() == 3
    wide = stored.groupBy("id").pivot("detector").agg(F.first("flag")).toPandas()
    wide = wide.sort_values("id", ignore_index=True)[flags.columns]
    pd.testing.assert_frame_equal(wide, flags, check_dtype=False)
    # A new log replays all batches under the same names.
    again = new_path(spark, "log")
    scoring.write_stream(arriving, fitted, path, "bearings", again).awaitTermination()
    assert predictions.read(spark, path, "bearings").count() == 8 * 222


def test_row_detectors_stream_as_projection(spark, planted):
    names = ["f0", "f1", "f2", "f3"]
    model = Pipeline().add("pca_mahalanobis").add("gaussian_distribution").fit(planted, names, "id")
    source = new_path(spark, "arriving")
    planted.write.parquet(source)
    arriving = spark.readStream.schema(planted.schema).parquet(source)
    query = (
        scoring.flag_stream(arriving, model)
        .writeStream.format("memory").queryName("flagged").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("flagged").count() == 612
    with_knn = Pipeline().add("knearest_neighbors").fit(planted, names, "id")
    with pytest.raises(ValueError, match="write_stream"):
        scoring.flag_stream(arriving, with_knn)


def test_plans_read_few_columns_and_avoid_products(spark, planted):
    path = new_path(spark, "wide")
    planted.withColumns({f"extra{i}": F.lit("x") for i in range(5)}).write.parquet(path)
    df = spark.read.parquet(path)
    names = ["f0", "f1"]
    model = Pipeline().add("pca_mahalanobis").add("gaussian_distribution").add("local_outlier_factor")
    plan = model.fit(df, names, "id").flag(df)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^\n]*)>", plan)
    assert "id:bigint,f0:double,f1:double" in schemas
    assert not any("extra" in s or "f2:" in s for s in schemas)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_detectors_on_one_feature(spark):
    x = np.r_[np.random.default_rng(3).standard_normal(200), 15.0][:, None]
    model = Pipeline().add("pca_mahalanobis", n_components=1).add("gaussian_distribution").add("kmeans", n_clusters=1)
    found = model.fit(table(spark, x), ["f0"], "id").flag(table(spark, x)).toPandas()
    assert found.sort_values("id").iloc[-1][list(model.specs)].all()


def test_edges_are_never_broadcast(spark, planted, monkeypatch):
    names = ["f0", "f1", "f2", "f3"]

    def plan(limit):
        monkeypatch.setattr(neighbours, "BROADCAST_POINTS", limit)
        scored = lof.fit_lof(planted, names, "id").score(planted, "id")
        return scored._jdf.queryExecution().executedPlan().toString()

    few, many = plan(10_000), plan(10)
    assert "BroadcastHashJoin" in few and "BuildRight" in few and "BuildLeft" not in few
    assert "SortMergeJoin" in many
