"""From request texts to stored results: parse, check, load, flag, store."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame

from strayrow.plans import versions
from strayrow.plans.pipeline import Pipeline
from strayrow.sources import predictions, split_json

ROW_IDS = ("request_id", "pos")


def train_on_requests(
    texts: DataFrame,
    pipeline: Pipeline,
    features: Sequence[str],
    path: str,
    model_id: str,
    column: str = "value",
) -> DataFrame:
    """Fit on the rows of all sound requests and save to ``path``; gives the rejected requests.

    Training again puts a new version of the model in place, which keeps its creation date.
    """
    rows, rejected = split_json.sort_out(split_json.parse(texts, column), features)
    fitted = pipeline.fit(rows, features, list(ROW_IDS))
    versions.save_version(texts.sparkSession, fitted, path, model_id)
    return rejected


def predict_requests(
    texts: DataFrame,
    model_path: str,
    prediction_path: str,
    model_id: str,
    prediction_id: str,
    prediction_date: datetime | None = None,
    column: str = "value",
) -> DataFrame:
    """Flag the rows of all sound requests with a saved pipeline and store them.

    Stored rows carry ``request_id`` and ``pos``, the row's place in its request. Gives
    the rejected requests with their errors; each request is in one of the two.
    """
    fitted = versions.load_newest(texts.sparkSession, model_path)
    rows, rejected = split_json.sort_out(split_json.parse(texts, column), fitted.features)
    predictions.write(fitted.flag(rows, "long"), prediction_path, model_id, prediction_id, prediction_date)
    return rejected
