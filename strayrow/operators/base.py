"""What every fitted detector offers: scores, flags and a state that can be stored.

Two kinds exist. A :class:`RowModel` looks at one row at a time, so its score is a
Column and many models share one projection. A :class:`JoinModel` compares rows with
the training table, so its score comes from a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any, ClassVar

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.operators import neighbours as nn
from strayrow.operators.frame import as_list, feature_columns


class NotTrainedError(RuntimeError):
    """Raised when a detector is asked for scores before it was fitted."""


class Fitted:
    """Base of all fitted detectors; ``features`` are the columns it was fitted on."""

    key: ClassVar[str]
    features: tuple[str, ...]

    def flag_column(self, score: Column) -> Column:
        raise NotImplementedError

    def score(self, df: DataFrame, id_col: str | Sequence[str], on_null: str = "error") -> DataFrame:
        raise NotImplementedError

    def flag(self, df: DataFrame, id_col: str | Sequence[str], on_null: str = "error") -> DataFrame:
        """Id columns, ``score`` and the boolean ``flag``."""
        return self.score(df, id_col, on_null).withColumn("flag", self.flag_column(F.col("score")))

    def state(self) -> tuple[dict[str, Any], dict[str, np.ndarray], dict[str, DataFrame]]:
        """Plain settings, small arrays and tables that make up the fitted model."""
        raise NotImplementedError

    @classmethod
    def restore(
        cls, settings: dict[str, Any], arrays: dict[str, np.ndarray], tables: dict[str, DataFrame]
    ) -> Fitted:
        raise NotImplementedError


class ThresholdRule:
    """Flags what scores above the stored threshold."""

    threshold: float

    def flag_column(self, score: Column) -> Column:
        return score > F.lit(float(self.threshold))


class RowModel(Fitted):
    def score_column(self, cells: Sequence[Column]) -> Column:
        """Score from the double columns of the features, null if one of them is null."""
        raise NotImplementedError

    def score(self, df: DataFrame, id_col: str | Sequence[str], on_null: str = "error") -> DataFrame:
        ids = [F.col(f"`{c}`") for c in as_list(id_col)]
        cells = df.select(*ids, *feature_columns(df, self.features, on_null))
        columns = [F.col(f"`{f}`") for f in self.features]
        return cells.select(*ids, self.score_column(columns).alias("score"))


class JoinModel(Fitted):
    """Scores come from the nearest training rows, found through ``index``."""

    index: nn.PointIndex
    n_neighbors: int
    method: str

    def add_score(self, found: DataFrame, ids: Sequence[str], name: str) -> DataFrame:
        """Score column for a table of ids, ``neighbours`` and columns that are passed on."""
        raise NotImplementedError

    def score(self, df: DataFrame, id_col: str | Sequence[str], on_null: str = "error") -> DataFrame:
        ids = as_list(id_col)
        rows = df.select(
            *[F.col(f"`{c}`") for c in ids], *feature_columns(df, self.features, on_null)
        )
        complete, missing = split_missing(rows, self.features, on_null)

        def finish(found: DataFrame, keys: Sequence[str]) -> DataFrame:
            return self.add_score(found, keys, "score").select(*keys, "score")

        scored = nn.neighbours(complete, ids, self.index, self.n_neighbors, self.method, finish=finish)
        return with_missing(scored.select(*ids, "score"), missing)


def split_missing(
    rows: DataFrame, features: Sequence[str], on_null: str
) -> tuple[DataFrame, DataFrame | None]:
    """Complete rows, and the rows with a missing cell if those are skipped."""
    if on_null != "skip":
        return rows, None
    missing = reduce(lambda a, b: a | b, [F.col(f"`{f}`").isNull() for f in features])
    return rows.filter(~missing), rows.filter(missing)


def with_missing(scored: DataFrame, missing: DataFrame | None) -> DataFrame:
    """Add the rows with a missing cell again; what they lack is null."""
    if missing is None:
        return scored
    known = [c for c in scored.columns if c in missing.columns]
    return scored.unionByName(missing.select(*known), allowMissingColumns=True)
