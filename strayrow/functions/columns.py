"""Scalar kernels as Column expressions, so they stay inside generated JVM code."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_FUNCS = ("max_distance", "average", "median")


def add_all(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def scaled(col: Column, shift: float, scale: float) -> Column:
    return (col.cast("double") - F.lit(float(shift))) / F.lit(float(scale))


def log_density(cols: Sequence[Column], mean: Sequence[float], var: Sequence[float]) -> Column:
    """Sum over the features of the log of the univariate normal density."""
    return add_all(
        [
            F.lit(-0.5 * math.log(2 * math.pi * v))
            - F.pow(c - F.lit(float(m)), F.lit(2.0)) / F.lit(2 * float(v))
            for c, m, v in zip(cols, mean, var)
        ]
    )


def whitened_distance(
    cols: Sequence[Column],
    mean: Sequence[float],
    axes: Sequence[Sequence[float]],
    spread: Sequence[float],
) -> Column:
    """Length of the projections on ``axes``, each divided by its ``spread``.

    With principal axes and their variances this is the Mahalanobis distance. A
    spread of zero marks an axis the training data does not use; it adds nothing.
    """
    centred = [c - F.lit(float(m)) for c, m in zip(cols, mean)]
    terms = [
        F.pow(add_all([c * F.lit(float(a)) for c, a in zip(centred, axis)]), F.lit(2.0))
        / F.lit(float(s))
        for axis, s in zip(axes, spread)
        if s > 0
    ]
    if not terms:
        return add_all(centred) * F.lit(0.0)
    return F.sqrt(add_all(terms))


def nearest_centroid_distance(
    cols: Sequence[Column], centroids: Sequence[Sequence[float]]
) -> Column:
    """Euclidean distance to the closest centroid, the one a row belongs to."""
    squares = [
        add_all([F.pow(c - F.lit(float(x)), F.lit(2.0)) for c, x in zip(cols, centroid)])
        for centroid in centroids
    ]
    return F.sqrt(squares[0] if len(squares) == 1 else F.least(*squares))


def mean_absolute_error(actual: Column, predicted: Column) -> Column:
    """Mean absolute error of two equally long arrays in one row."""
    total = F.aggregate(
        F.zip_with(actual, predicted, lambda a, b: F.abs(b - a)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.try_divide(total, F.size(actual).cast("double"))


def point_line_distance(
    x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column
) -> Column:
    """Distance in the plane of (x, y) to the line through the two given points."""
    dx, dy = x2 - x1, y2 - y1
    cross = F.abs(dx * (y1 - y) - dy * (x1 - x))
    return F.try_divide(cross, F.sqrt(dx * dx + dy * dy))


def neighbour_score(distances: Column, k: int, how: str) -> Column:
    """Summary of the ascending array of the ``k`` neighbour distances of a row."""
    if how == "max_distance":
        return F.element_at(distances, k)
    if how == "average":
        total = F.aggregate(distances, F.lit(0.0), lambda acc, x: acc + x)
        return total / F.lit(float(k))
    if how == "median":
        if k % 2:
            return F.element_at(distances, k // 2 + 1)
        return (F.element_at(distances, k // 2) + F.element_at(distances, k // 2 + 1)) / 2
    raise ValueError(f"unknown score function {how!r}, choose from {', '.join(SCORE_FUNCS)}")
