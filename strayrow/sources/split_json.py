"""Split-oriented requests: ``{"id"?, "columns": [...], "data": [[...], ...]}``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.operators import frame

SCHEMA = "id string, columns array<string>, data array<array<double>>, _malformed string"


def parse(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts to ``(request_id, columns, data, malformed)``.

    A request without id is named by its hash. ``malformed`` marks a text that is null,
    no JSON, or holds values of other types; it gives no rows, see :func:`sort_out`.
    """
    text = F.col(column)
    doc = F.from_json(text, SCHEMA, {"columnNameOfCorruptRecord": "_malformed"})
    return raw.select(text.alias("_text"), doc.alias("_doc")).select(
        F.coalesce("_doc.id", F.sha2("_text", 256), F.lit("null")).alias("request_id"),
        F.col("_doc.columns").alias("columns"),
        F.col("_doc.data").alias("data"),
        (F.col("_text").isNull() | F.col("_doc").isNull() | F.col("_doc._malformed").isNotNull()).alias("malformed"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files with one request per line."""
    return parse(spark.read.text(path))


def sort_out(documents: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the sound documents, and ``(request_id, error_columns, error_data)`` of all others."""
    checked = frame.with_document_errors(documents, features)
    malformed = F.col("malformed") if "malformed" in documents.columns else F.lit(False)
    checked = checked.withColumns(
        {
            "error_columns": F.when(malformed, "").otherwise(F.col("error_columns")),
            "error_data": F.when(malformed, "not a request").otherwise(F.col("error_data")),
        }
    )
    sound = (F.col("error_columns") == "") & (F.col("error_data") == "")
    rejected = checked.filter(~sound).select("request_id", "error_columns", "error_data")
    return unpack(checked.filter(sound), features), rejected


def unpack(documents: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per data row: ``request_id``, ``pos`` and the features, looked up by name.

    Documents without rows give none; :func:`sort_out` names them.
    """
    rows = documents.select("request_id", "columns", F.posexplode("data").alias("pos", "cells"))

    def cell(name: str):
        at = F.array_position("columns", name)
        return F.get(F.col("cells"), (at - 1).cast("int"))

    return rows.select("request_id", "pos", *[cell(f).alias(f) for f in features])
