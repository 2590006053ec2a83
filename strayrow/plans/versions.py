"""Stored pipelines that can be replaced while they are read.

A model's folder holds one folder for each version and a table of pointers with one row
for each complete version. Saving writes a new version folder and, as the last step,
appends its pointer row; loading takes the pointer with the highest number. A save that
fails leaves no pointer, so the model before it stays the one that is loaded, and whoever
has loaded a version keeps reading its folder. ``prune`` deletes versions explicitly.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from strayrow.plans.pipeline import FittedPipeline
from strayrow.session import delete_folder
from strayrow.sources import state

POINTERS = "number long, version string, model_id string, created timestamp, updated timestamp"


def versions(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """The complete versions of a model, the first one first; none if nothing was saved."""
    try:
        rows = spark.read.schema(POINTERS).parquet(f"{path}/pointers").collect()
    except AnalysisException:
        return []
    return sorted((r.asDict() for r in rows), key=lambda r: (r["number"], r["version"]))


def version_path(path: str, pointer: dict[str, Any]) -> str:
    return f"{path}/versions/{pointer['version']}"


def save_version(
    spark: SparkSession, fitted: FittedPipeline, path: str, model_id: str, when: datetime | None = None
) -> dict[str, Any]:
    """Store a fitted pipeline as the model's newest version and give its pointer.

    The model keeps the date it was created; ``updated`` is now, or ``when``. A folder
    that holds another model is left alone.
    """
    known = versions(spark, path)
    if known and known[-1]["model_id"] != model_id:
        raise ValueError(f"{path} holds the model {known[-1]['model_id']}, not {model_id}")
    now = when or datetime.now(timezone.utc)
    created = known[0]["created"] if known else now
    number = known[-1]["number"] + 1 if known else 1
    version = f"{number:06d}-{uuid.uuid4().hex[:8]}"
    pointer = {"number": number, "version": version, "model_id": model_id, "created": created, "updated": now}
    fitted.save(spark, version_path(path, pointer), model_id, created, now)
    row = tuple(pointer[c.split()[0]] for c in POINTERS.split(", "))
    spark.createDataFrame([row], POINTERS).coalesce(1).write.mode("append").parquet(f"{path}/pointers")
    return next(v for v in versions(spark, path) if v["version"] == version)


def load_newest(spark: SparkSession, path: str) -> FittedPipeline:
    """The newest complete version, or a pipeline that was saved at the path itself."""
    known = versions(spark, path)
    if not known:
        return FittedPipeline.load(spark, path)
    return FittedPipeline.load(spark, version_path(path, known[-1]))


def metadata(spark: SparkSession, path: str) -> dict[str, Any]:
    """Model id, dates, detectors and columns of the newest version."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no stored model at {path}")
    return state.read_metadata(spark, version_path(path, known[-1]))


def prune(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete the folders of all but the newest ``keep`` versions; gives how many went.

    Pointers stay, so the creation date does. Models loaded from a deleted version that
    read stored points, such as the neighbour detectors, stop working.
    """
    if keep < 1:
        raise ValueError("at least one version stays")
    old = versions(spark, path)[:-keep]
    for pointer in old:
        delete_folder(spark, version_path(path, pointer))
    return len(old)
