from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from strayrow import session
from strayrow.operators import frame
from strayrow.session import new_path
from strayrow.sources import csv, predictions, split_json

COLUMNS = ["speed", "torque", "load"]
ROWS = [[1.5, 20.0, 0.25], [2.5, 21.0, 0.5], [3.5, 19.0, 0.75]]


def documents(spark, *requests):
    return split_json.parse(spark.createDataFrame([(json.dumps(r),) for r in requests], "value string"))


def errors(spark, **request):
    row = frame.validate_documents(documents(spark, {"id": "r", **request}), COLUMNS).first()
    return (row["error_columns"], row["error_data"]) if row else None


def test_rows_are_read_by_name(spark):
    swapped = [[c, a, b] for a, b, c in ROWS]
    docs = documents(
        spark,
        {"id": "one", "columns": COLUMNS, "data": ROWS},
        {"id": "two", "columns": ["load", "speed", "torque"], "data": swapped},
    )
    rows = split_json.unpack(docs, COLUMNS).orderBy("request_id", "pos").collect()
    assert [list(r)[2:] for r in rows] == ROWS + ROWS
    assert [r["pos"] for r in rows] == [0, 1, 2, 0, 1, 2]


def test_request_without_id_gets_a_stable_name(spark):
    request = {"columns": COLUMNS, "data": ROWS}
    a, b = (documents(spark, request).first()["request_id"] for _ in range(2))
    assert a == b and len(a) == 64


def test_missing_column_and_short_row_are_null(spark):
    docs = documents(spark, {"id": "x", "columns": ["speed"], "data": [[1.0], []]})
    rows = split_json.unpack(docs, ["speed", "load"]).orderBy("pos").collect()
    assert [tuple(r)[2:] for r in rows] == [(1.0, None), (None, None)]


def test_documents_are_read_from_files(spark):
    path = new_path(spark, "requests")
    text = json.dumps({"id": "f", "columns": COLUMNS, "data": ROWS})
    spark.createDataFrame([(text,)], "value string").write.text(path)
    assert split_json.unpack(split_json.read(spark, path), COLUMNS).count() == 3


def test_clean_documents_have_no_errors(spark):
    assert errors(spark, columns=COLUMNS, data=ROWS) is None
    assert errors(spark, columns=COLUMNS[::-1], data=ROWS) is None


@pytest.mark.parametrize(
    "request_, bad_columns, bad_data",
    [
        (dict(columns=COLUMNS, data=[]), "", "no rows"),
        (dict(columns=COLUMNS, data=[[1, 2, 3], [1, 2]]), "", "rows differ in length"),
        (dict(columns=COLUMNS, data=[[1, 2]]), "", "rows have 2 cells for 3 columns"),
        (dict(columns=COLUMNS[:2], data=[[1, 2]]), "columns are not those of the model", ""),
        (
            dict(columns=[*COLUMNS, "wind"], data=[[1, 2, 3]]),
            "columns are not those of the model",
            "rows have 3 cells for 4 columns",
        ),
    ],
)
def test_faulty_documents(spark, request_, bad_columns, bad_data):
    assert errors(spark, **request_) == (bad_columns, bad_data)


def test_bad_documents_are_named(spark):
    texts = [
        json.dumps({"id": "good", "columns": COLUMNS, "data": ROWS}),
        json.dumps({"id": "text cell", "columns": COLUMNS, "data": [[1, "x", 2]]}),
        "no JSON",
        None,
        json.dumps({"id": "empty", "columns": COLUMNS, "data": []}),
        json.dumps({"id": "null row", "columns": COLUMNS, "data": [None]}),
    ]
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    rows, rejected = split_json.sort_out(split_json.parse(raw), COLUMNS)
    assert [tuple(r)[2:] for r in rows.orderBy("pos").collect()] == [tuple(r) for r in ROWS]
    found = sorted(r["error_data"] for r in rejected.collect())
    assert found == ["no rows", *["not a request"] * 3, "rows have 0 cells for 3 columns"]


def test_ids_of_predictions_stay_texts(spark):
    path = new_path(spark, "predictions")
    flags = table(spark, np.ones((5, 1)), ["score"])
    predictions.write(flags, path, "007", "2024-01-01")
    assert predictions.read(spark, path).select("model_id", "prediction_id").distinct().collect() == [
        ("007", "2024-01-01")
    ]
    assert predictions.read(spark, path, "007", "2024-01-01").count() == 5
    assert predictions.read(spark, path, "7").count() == 0


def test_table_columns():
    frame.check_columns(["a", "b"], ["b", "a"])
    with pytest.raises(ValueError, match="missing \\['b'\\], unexpected \\['c'\\]"):
        frame.check_columns(["a", "c"], ["a", "b"])


def test_nulls_raise_or_are_skipped(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 2.0), (2, None, 3.0), (3, float("nan"), 4.0)], "id long, a double, b double"
    )
    with pytest.raises(Exception, match="feature a has a null or NaN cell"):
        frame.fit_rows(df, ["id"], ["a", "b"], "error").collect()
    assert frame.fit_rows(df, ["id"], ["a", "b"], "skip").count() == 1
    with pytest.raises(ValueError, match="on_null"):
        frame.fit_rows(df, ["id"], ["a"], "drop")


def test_text_features_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "id long, a string")
    with pytest.raises(ValueError, match="not numeric"):
        frame.fit_rows(df, ["id"], ["a"], "error")
    with pytest.raises(ValueError, match="not a column"):
        frame.fit_rows(df, ["id"], ["z"], "error")


def test_csv_round_trip(spark, bearings):
    names = bearings.columns[1:]
    path = new_path(spark, "csv")
    bearings.withColumnRenamed("id", "").write.csv(path, header=True)
    back = csv.read(spark, path, names, "id", "long")
    assert back.exceptAll(bearings).count() == 0 and back.count() == 222
    with pytest.raises(ValueError, match="columns"):
        csv.read(spark, path, names[::-1])


def test_predictions_replace_themselves(spark):
    path = new_path(spark, "predictions")
    flags = table(spark, np.ones((3, 1)), ["score"]).withColumn("flag", F.col("score") > 0)
    when = datetime(2024, 1, 1)
    for model, prediction in (("m", "a"), ("m", "b"), ("m", "a"), ("n", "a")):
        predictions.write(flags, path, model, prediction, when)
    assert predictions.read(spark, path).count() == 9
    assert predictions.read(spark, path, "m").count() == 6
    one = predictions.read(spark, path, "m", "a")
    assert one.count() == 3 and one.first()["prediction_date"] == when


def test_release_deletes_derived_tables(spark):
    kept = new_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    derived = session.materialize(spark.range(5), "derived")
    assert derived.count() == 5
    assert session.release(spark) >= 1 and session.release(spark) == 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|not exist|PATH_NOT_FOUND"):
        spark.read.parquet(derived.inputFiles()[0]).count()
    assert spark.read.parquet(kept).count() == 3


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
