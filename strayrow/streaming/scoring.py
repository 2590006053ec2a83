"""Scoring of arriving rows with a fitted pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strayrow.operators import neighbours as nn
from strayrow.operators.base import JoinModel, RowModel
from strayrow.plans.pipeline import FittedPipeline
from strayrow.session import cleaned_up
from strayrow.sources import predictions


def flag_stream(
    rows: DataFrame, fitted: FittedPipeline, output: str = "wide", on_null: str = "skip"
) -> DataFrame:
    """Streaming flags as a plain projection, for detectors that look at single rows."""
    joined = [k for k, m in fitted.models.items() if not isinstance(m, RowModel)]
    if joined:
        raise ValueError(f"{', '.join(joined)} compare with training rows, use write_stream")
    return fitted.flag(rows, output, on_null)


def batch_name(number: int) -> str:
    return f"batch-{number:010d}"


def compact_stream(spark: SparkSession, path: str, model_id: str, upto: int, files: int = 1) -> str:
    """Put the stored batches up to number ``upto`` together; gives the name of their prediction.

    Batches leave small files; this leaves ``files`` of them. Rows keep their date. The
    batches are deleted only after their rows stand in the new prediction, and a reader
    who asks for the model's rows while both exist should name the prediction.
    Running it again after a failure is safe. ``upto`` must be a finished batch.
    """
    name = f"batches-to-{upto:010d}"
    stored = predictions.names(spark, path, model_id)
    parts = [p for p in stored if p.startswith("batch-") and p <= batch_name(upto)]
    parts += [p for p in stored if p.startswith("batches-to-") and p < name]
    if parts:
        predictions.merge(spark, path, model_id, parts, name, files)
    return name


def write_stream(
    rows: DataFrame,
    fitted: FittedPipeline,
    path: str,
    model_id: str,
    checkpoint: str,
    on_null: str = "skip",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Flag every micro-batch and store it as one prediction of the model.

    The prediction is named by the batch number, so a batch replayed after a failure
    replaces what it wrote before. Works for all detectors: those that compare rows with
    training points join each batch with the stored points, and the tables that such a
    join derives are deleted when the batch has been stored. ``compact_stream`` puts
    stored batches together.
    """

    for model in fitted.models.values():
        if isinstance(model, JoinModel):
            # read by all batches, so not among the tables of one
            nn.prepare(model.index, model.method)

    def store(batch: DataFrame, number: int) -> None:
        with cleaned_up(batch.sparkSession):
            flags = fitted.flag(batch, "long", on_null)
            predictions.write(flags, path, model_id, batch_name(number))

    return (
        rows.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
