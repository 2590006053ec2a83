"""PCA projection, Mahalanobis distance and the detector built from the two."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions import columns as fc
from strayrow.functions.arrow import row_function
from strayrow.operators.base import RowModel, ThresholdRule
from strayrow.operators.frame import fit_rows
from strayrow.operators.stats import FeatureStats, collect_stats
from strayrow.operators.threshold import contamination_threshold

# Larger projections are one matrix product per Arrow batch instead of an expression.
MAX_EXPRESSION_TERMS = 512
# Directions with less than this share of the largest variance count as unused.
FLAT_DIRECTION = 1e-14


@dataclass(frozen=True)
class Projection:
    """Principal axes (one per row), the centre and the sample variance along each axis."""

    features: tuple[str, ...]
    mean: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray

    def columns(self, cells: Sequence[Column]) -> list[Column]:
        centred = [c - F.lit(float(m)) for c, m in zip(cells, self.mean)]
        return [
            fc.add_all([c * F.lit(float(a)) for c, a in zip(centred, axis)]).alias(f"pc{i + 1}")
            for i, axis in enumerate(self.axes)
        ]


def projection_from_stats(
    stats: FeatureStats, features: Sequence[str], n_components: int | float
) -> Projection:
    """Leading axes of the covariance.

    A whole number gives that many axes; a share between 0 and 1 gives the fewest
    axes that together explain more than that share of the variance. The largest
    loading of every axis is positive.
    """
    values, vectors = np.linalg.eigh(stats.cov)
    order = np.argsort(values)[::-1]
    values, axes = np.clip(values[order], 0.0, None), vectors[:, order].T
    peak = np.argmax(np.abs(axes), axis=1)
    axes = axes * np.sign(axes[np.arange(len(axes)), peak])[:, None]
    total = values.sum()
    ratio = values / total if total > 0 else np.zeros_like(values)
    if isinstance(n_components, float) and 0.0 < n_components < 1.0:
        k = int(np.searchsorted(np.cumsum(ratio), n_components, side="right")) + 1
        k = min(k, len(values))
    elif float(n_components).is_integer() and 1 <= n_components <= min(len(values), stats.n):
        k = int(n_components)
    else:
        raise ValueError(
            f"n_components must be a share in (0, 1) or 1 to {min(len(values), stats.n)}"
        )
    return Projection(tuple(features), stats.mean, axes[:k], values[:k], ratio[:k])


def fit_pca(df: DataFrame, features: Sequence[str], n_components: int | float = 2) -> Projection:
    return projection_from_stats(collect_stats(df, features, with_cov=True), features, n_components)


def whitening(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes and variances whose scaled projections give the (pseudo-)inverse of ``cov``."""
    values, vectors = np.linalg.eigh(cov)
    spread = np.where(values > FLAT_DIRECTION * max(values.max(), 0.0), values, 0.0)
    return vectors.T, spread


def distance_column(
    cells: Sequence[Column], mean: np.ndarray, axes: np.ndarray, spread: np.ndarray
) -> Column:
    if axes.size <= MAX_EXPRESSION_TERMS:
        return fc.whitened_distance(cells, mean, axes, spread)
    used = spread > 0
    weights = (axes[used] / np.sqrt(spread[used])[:, None]).T

    def distance(matrix: np.ndarray) -> np.ndarray:
        return np.sqrt((((matrix - mean) @ weights) ** 2).sum(axis=1))

    return row_function(distance, list(cells))


def mahalanobis_column(cells: Sequence[Column], stats: FeatureStats) -> Column:
    """Mahalanobis distance of a row to the distribution the statistics describe."""
    axes, spread = whitening(stats.cov)
    return distance_column(cells, stats.mean, axes, spread)


@dataclass(frozen=True)
class PcaMahalanobis(ThresholdRule, RowModel):
    key = "pca_mahalanobis"
    features: tuple[str, ...]
    mean: np.ndarray
    axes: np.ndarray
    spread: np.ndarray
    threshold: float = float("nan")

    def score_column(self, cells: Sequence[Column]) -> Column:
        return distance_column(cells, self.mean, self.axes, self.spread)

    def state(self):
        arrays = {"mean": self.mean, "axes": self.axes, "spread": self.spread}
        return {"features": list(self.features), "threshold": self.threshold}, arrays, {}

    @classmethod
    def restore(cls, settings, arrays, tables):
        return cls(tuple(settings["features"]), **arrays, threshold=settings["threshold"])


def unfitted_threshold(
    stats: FeatureStats, features: Sequence[str], n_components: int | float = 2
) -> PcaMahalanobis:
    """The detector without its threshold; scores only need the statistics."""
    p = projection_from_stats(stats, features, n_components)
    spread = np.where(p.variance > FLAT_DIRECTION * p.variance.max(), p.variance, 0.0)
    return PcaMahalanobis(tuple(features), p.mean, p.axes, spread)


def fit_pca_mahalanobis(
    df: DataFrame,
    features: Sequence[str],
    n_components: int | float = 2,
    contamination: float = 0.1,
    on_null: str = "error",
) -> PcaMahalanobis:
    rows = fit_rows(df, [], features, on_null)
    stats = collect_stats(rows, features, with_cov=True)
    model = unfitted_threshold(stats, features, n_components)
    scores = rows.select(model.score_column([F.col(f"`{f}`") for f in features]).alias("score"))
    cut = contamination_threshold(scores, "score", contamination, stats.n)
    return PcaMahalanobis(model.features, model.mean, model.axes, model.spread, cut)
