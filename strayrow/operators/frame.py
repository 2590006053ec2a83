"""Feature tables: picking, casting and checking the columns a detector works on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MODES = ("error", "skip")


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def spread_array(df: DataFrame, column: str, size: int, prefix: str = "f") -> DataFrame:
    """Replace an array column of fixed size by one double column per element."""
    keep = [F.col(c) for c in df.columns if c != column]
    cells = [F.get(F.col(column), i).cast("double").alias(f"{prefix}{i}") for i in range(size)]
    return df.select(*keep, *cells)


def check_columns(provided: Sequence[str], expected: Sequence[str]) -> None:
    """The two column sets must agree in both directions; their order is free."""
    missing = sorted(set(expected) - set(provided))
    extra = sorted(set(provided) - set(expected))
    if missing or extra:
        raise ValueError(f"columns differ: missing {missing}, unexpected {extra}")


def check_numeric(df: DataFrame, features: Sequence[str]) -> None:
    for name in features:
        if name not in df.columns:
            raise ValueError(f"feature {name!r} is not a column of the table")
        if not isinstance(df.schema[name].dataType, T.NumericType):
            raise ValueError(f"feature {name!r} is not numeric")


def feature_columns(df: DataFrame, features: Sequence[str], on_null: str = "error") -> list[Column]:
    """Double columns of the features with nulls and NaN handled.

    ``error`` raises when a row with a missing cell is read, ``skip`` turns every
    missing cell into null, which gives that row a null score and a null flag.
    """
    if on_null not in NULL_MODES:
        raise ValueError(f"on_null must be one of {', '.join(NULL_MODES)}")
    check_numeric(df, features)
    out = []
    for name in features:
        cell = f"CAST(`{name}` AS DOUBLE)"
        bad = "NULL"
        if on_null == "error":
            text = name.replace("\\", "\\\\").replace("'", "\\'")
            bad = f"raise_error('feature {text} has a null or NaN cell')"
        checked = f"CASE WHEN {cell} IS NULL OR isnan({cell}) THEN {bad} ELSE {cell} END"
        out.append(F.expr(checked).alias(name))
    return out


def fit_rows(df: DataFrame, keep: Sequence[str], features: Sequence[str], on_null: str) -> DataFrame:
    """Rows a detector is fitted on: only the needed columns, only complete rows."""
    out = df.select(*[F.col(f"`{c}`") for c in keep], *feature_columns(df, features, on_null))
    return out.dropna(subset=list(features)) if on_null == "skip" else out


def with_document_errors(
    documents: DataFrame,
    model_columns: Sequence[str],
    columns: str = "columns",
    data: str = "data",
) -> DataFrame:
    """Split-oriented documents with ``error_columns`` and ``error_data``, empty where a check passed.

    A null row has no cells.
    """
    names = F.coalesce(F.col(columns), F.array().cast("array<string>"))
    expected = F.array(*[F.lit(c) for c in model_columns])
    same = (F.size(F.array_except(names, expected)) == 0) & (
        F.size(F.array_except(expected, names)) == 0
    )
    lengths = F.array_distinct(
        F.transform(F.col(data), lambda row: F.when(row.isNull(), 0).otherwise(F.size(row)))
    )
    empty = F.col(data).isNull() | (F.size(data) == 0)
    ragged = F.size(lengths) > 1
    misfit = (F.size(lengths) == 1) & (F.get(lengths, 0) != F.size(names))
    error_columns = F.when(same, "").otherwise("columns are not those of the model")
    error_data = (
        F.when(empty, "no rows")
        .when(ragged, "rows differ in length")
        .when(
            misfit,
            F.format_string("rows have %d cells for %d columns", F.get(lengths, 0), F.size(names)),
        )
        .otherwise("")
    )
    return documents.withColumns({"error_columns": error_columns, "error_data": error_data})


def validate_documents(
    documents: DataFrame,
    model_columns: Sequence[str],
    key: str = "request_id",
    columns: str = "columns",
    data: str = "data",
) -> DataFrame:
    """Column and row-shape errors of split-oriented documents, one row per bad document.

    Output: ``key``, ``error_columns`` and ``error_data``; a message is empty when
    its check passed, and clean documents give no row.
    """
    checked = with_document_errors(documents, model_columns, columns, data)
    return checked.select(F.col(key), "error_columns", "error_data").filter(
        "error_columns <> '' OR error_data <> ''"
    )
