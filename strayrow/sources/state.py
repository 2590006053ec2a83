"""Fitted state as parquet tables.

A detector is a folder: ``arrays`` holds its small parameter arrays, further folders
its tables (such as training points). One ``metadata`` row, written last, makes the
state complete; without it, or with a part missing, loading fails.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from strayrow.operators.base import Fitted

ARRAYS_SCHEMA = "name string, shape array<int>, cells array<double>"
METADATA_SCHEMA = (
    "model_id string, created timestamp, updated timestamp, "
    "models array<string>, columns array<string>, settings string"
)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no stored state at {path}") from e


def write_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    rows = [
        (name, list(map(int, np.shape(a))), np.ravel(np.asarray(a, dtype=float)).tolist())
        for name, a in arrays.items()
    ]
    spark.createDataFrame(rows, ARRAYS_SCHEMA).coalesce(1).write.parquet(path)


def read_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    rows = read_table(spark, path).collect()
    return {r["name"]: np.array(r["cells"], dtype=float).reshape(r["shape"]) for r in rows}


def write_parts(
    spark: SparkSession, model: Fitted, path: str, with_tables: bool = True
) -> dict[str, Any]:
    """Write the arrays and tables of a detector; its settings are returned.

    Without tables, another detector has stored the same ones.
    """
    settings, arrays, tables = model.state()
    write_arrays(spark, arrays, f"{path}/arrays")
    for name, table in tables.items() if with_tables else ():
        table.write.parquet(f"{path}/{name}")
    return {"settings": settings, "tables": sorted(tables)}


def read_parts(
    spark: SparkSession,
    kind: type[Fitted],
    record: dict[str, Any],
    path: str,
    tables_path: str | None = None,
) -> Fitted:
    arrays = read_arrays(spark, f"{path}/arrays")
    tables = {
        name: read_table(spark, f"{tables_path or path}/{name}") for name in record["tables"]
    }
    return kind.restore(record["settings"], arrays, tables)


def write_metadata(
    spark: SparkSession, path: str, model_id: str, created, updated, models, columns, settings
) -> None:
    row = (model_id, created, updated, list(models), list(columns), json.dumps(settings))
    spark.createDataFrame([row], METADATA_SCHEMA).coalesce(1).write.parquet(f"{path}/metadata")


def read_metadata(spark: SparkSession, path: str) -> dict[str, Any]:
    row = read_table(spark, f"{path}/metadata").first()
    if row is None:
        raise FileNotFoundError(f"no stored state at {path}")
    return {**row.asDict(), "settings": json.loads(row["settings"])}
