"""Prediction table: flags per row and detector, kept by model and prediction."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strayrow.session import delete_folder


def write(
    flags: DataFrame,
    path: str,
    model_id: str,
    prediction_id: str,
    prediction_date: datetime | None = None,
) -> None:
    """Store long flags under their model and prediction.

    Writing the same prediction again replaces it, so a repeated job or a replayed
    stream batch leaves one copy.
    """
    when = prediction_date or datetime.now(timezone.utc).replace(tzinfo=None)
    record = flags.select(
        F.lit(model_id).alias("model_id"),
        F.lit(prediction_id).alias("prediction_id"),
        F.lit(when).cast("timestamp_ntz").alias("prediction_date"),
        "*",
    )
    (
        record.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model_id", "prediction_id")
        .parquet(path)
    )


def read(
    spark: SparkSession, path: str, model_id: str | None = None, prediction_id: str | None = None
) -> DataFrame:
    """The stored table; the two ids prune the folders that are read and stay texts, such as ``007``."""
    found = spark.read.parquet(path).schema
    ids = ("model_id", "prediction_id")
    fields = [T.StructField(f.name, T.StringType()) if f.name in ids else f for f in found]
    table = spark.read.schema(T.StructType(fields)).parquet(path)
    if model_id is not None:
        table = table.filter(F.col("model_id") == model_id)
    if prediction_id is not None:
        table = table.filter(F.col("prediction_id") == prediction_id)
    return table


def names(spark: SparkSession, path: str, model_id: str) -> list[str]:
    """The predictions stored for a model."""
    rows = read(spark, path, model_id).select("prediction_id").distinct().collect()
    return sorted(r["prediction_id"] for r in rows)


def merge(spark: SparkSession, path: str, model_id: str, parts: list[str], name: str, files: int = 1) -> None:
    """Store the rows of several predictions as the one prediction ``name``, then delete the several.

    The merged folder appears in one piece when its rows are written. If it is there
    already, an earlier run was stopped after that, and only the deletions are left.
    """
    if name not in names(spark, path, model_id):
        rows = read(spark, path, model_id).filter(F.col("prediction_id").isin(parts))
        (
            rows.withColumn("prediction_id", F.lit(name))
            .repartition(files)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("model_id", "prediction_id")
            .parquet(path)
        )
    for part in parts:
        delete_folder(spark, f"{path}/model_id={model_id}/prediction_id={part}")
