"""Streams with neighbour detectors leave nothing behind; fits report and run side by side."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strayrow.operators import neighbours as nn
from strayrow.plans.pipeline import Pipeline
from strayrow.session import cleaned_up, materialize, new_path, scratch, shared_dir
from strayrow.sources import predictions
from strayrow.streaming import scoring

F4 = [f"f{i}" for i in range(4)]


def tables(spark) -> set[str]:
    """Folders below the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/strayrow")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()


def neighbours_only(df, method):
    return Pipeline().add("knearest_neighbors", method=method).add("local_outlier_factor", method=method).fit(df, F4, "id")


@pytest.mark.parametrize("method", ["broadcast", "pivot", "axes"])
def test_batches_are_cleaned_up(spark, planted, monkeypatch, method):
    monkeypatch.setattr(nn, "CELL_POINTS", 60)
    source = new_path(spark, "arriving")
    planted.repartition(3).write.parquet(source)
    path, log = new_path(spark, "flags"), new_path(spark, "log")
    known = tables(spark)
    with cleaned_up(spark):
        fitted = neighbours_only(planted, method)
        expected = fitted.flag(planted, "long").orderBy("id", "detector").select("id", "detector", "flag").collect()
        arriving = spark.readStream.schema(planted.schema).option("maxFilesPerTrigger", 1).parquet(source)
        before = tables(spark)
        scoring.write_stream(arriving, fitted, path, "m", log).awaitTermination()
        # only what all batches share was added
        added = {t.rsplit("-", 1)[0] for t in tables(spark) - before - {path.rsplit("/", 1)[1], log.rsplit("/", 1)[1]}}
        assert added <= {"cells", "codes", "crowded", "leaves"}
        got = predictions.read(spark, path, "m").orderBy("id", "detector").select("id", "detector", "flag").collect()
        assert got == expected
    assert tables(spark) - known <= {path.rsplit("/", 1)[1], log.rsplit("/", 1)[1]}


def test_batches_are_put_together(spark, planted):
    source = new_path(spark, "arriving")
    planted.repartition(4).write.parquet(source)
    path, log = new_path(spark, "flags"), new_path(spark, "log")
    fitted = Pipeline().add("pca_mahalanobis").fit(planted, F4, "id")
    arriving = spark.readStream.schema(planted.schema).option("maxFilesPerTrigger", 1).parquet(source)
    scoring.write_stream(arriving, fitted, path, "m", log).awaitTermination()
    columns = ["id", "detector", "score", "flag", "prediction_date"]
    before = predictions.read(spark, path, "m").select(columns).orderBy("id").collect()
    assert predictions.names(spark, path, "m") == [scoring.batch_name(i) for i in range(4)]
    name = scoring.compact_stream(spark, path, "m", 2)
    assert predictions.names(spark, path, "m") == [scoring.batch_name(3), name]
    assert predictions.read(spark, path, "m").select(columns).orderBy("id").collect() == before
    # a run that stopped before the deletions is finished, not repeated
    rows = predictions.read(spark, path, "m", name).limit(5).drop("model_id", "prediction_id", "prediction_date")
    predictions.write(rows, path, "m", scoring.batch_name(1))
    assert scoring.compact_stream(spark, path, "m", 2) == name
    last = scoring.compact_stream(spark, path, "m", 3)
    assert predictions.names(spark, path, "m") == [last]
    assert predictions.read(spark, path, "m").select(columns).orderBy("id").collect() == before
    assert len({r[0] for r in predictions.read(spark, path, "m").select(F.input_file_name()).distinct().collect()}) == 1
    assert scoring.compact_stream(spark, path, "m", 3) == last


def test_blocks_delete_their_tables_after_errors_too(spark):
    known = tables(spark)
    with pytest.raises(ZeroDivisionError), cleaned_up(spark):
        materialize(spark.range(3), "outer")
        with cleaned_up(spark):
            materialize(spark.range(3), "inner")
        assert len(tables(spark) - known) == 1
        raise ZeroDivisionError
    with pytest.raises(ZeroDivisionError), scratch(spark) as keep:
        assert keep(spark.range(3), "some").count() == 3
        raise ZeroDivisionError
    assert tables(spark) == known


def pipeline():
    return (
        Pipeline().add("pca_mahalanobis").add("kmeans", n_clusters=3).add("one_class_svm").add("isolation_forest", n_estimators=10)
        .add("knearest_neighbors").add("autoencoder", hidden_neurons=[2, 2], epochs=1)
    )


def test_side_by_side_fits_equal_serial_ones(spark, planted):
    seen = []
    one = pipeline().fit(planted, F4, "id")
    many = pipeline().fit(planted, F4, "id", parallel=3, progress=seen.append)
    assert list(one.models) == list(many.models)
    for key, model in one.models.items():
        assert np.array_equal(model.threshold, many.models[key].threshold), key
    assert sorted(p.detector for p in seen) == sorted(one.models)
    assert [p.done for p in seen] == list(range(1, 7)) and {p.total for p in seen} == {6} and all(p.seconds >= 0 for p in seen)
    serial = []
    pipeline().fit(planted, F4, "id", progress=serial.append)
    assert [p.detector for p in serial] == list(one.models)


def test_an_error_in_one_fit_ends_the_others(spark, planted):
    bad = pipeline().add("autoencoder", hidden_neurons=[8, 8])
    with pytest.raises(ValueError, match="neurons"):
        bad.fit(planted, F4, "id", parallel=3)
    with pytest.raises(ValueError, match="parallel"):
        bad.fit(planted, F4, "id", parallel=0)
