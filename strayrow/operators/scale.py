"""Min-max and standard scaling as plain projections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions import columns as fc
from strayrow.operators.stats import FeatureStats, collect_stats

SCALERS = ("minmax", "standard")


@dataclass(frozen=True)
class Scaler:
    """Fitted ``(x - shift) / scale`` per feature; new data is not clipped."""

    kind: str
    features: tuple[str, ...]
    shift: np.ndarray
    scale: np.ndarray

    def columns(self, cells: Sequence[Column]) -> list[Column]:
        return [
            fc.scaled(c, a, b).alias(f)
            for c, f, a, b in zip(cells, self.features, self.shift, self.scale)
        ]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the feature columns replaced by their scaled values."""
        cells = self.columns([F.col(f"`{f}`") for f in self.features])
        return df.withColumns(dict(zip(self.features, cells)))


def scaler_from_stats(stats: FeatureStats, features: Sequence[str], kind: str = "minmax") -> Scaler:
    if kind == "minmax":
        shift, scale = stats.low, stats.high - stats.low
    elif kind == "standard":
        shift, scale = stats.mean, np.sqrt(stats.var)
    else:
        raise ValueError(f"unknown scaler {kind!r}, choose from {', '.join(SCALERS)}")
    # A constant feature has no spread: it is only shifted.
    return Scaler(kind, tuple(features), shift, np.where(scale > 0, scale, 1.0))


def fit_scaler(df: DataFrame, features: Sequence[str], kind: str = "minmax") -> Scaler:
    return scaler_from_stats(collect_stats(df, features), features, kind)
