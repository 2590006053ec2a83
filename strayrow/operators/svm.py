"""One-class support vector machine on Nyström features.

Rows are mapped to their kernel values with a few landmark rows (Williams and Seeger
2001). In that space the one-class problem (Schölkopf and others 2001) is to find the
shortest vector in the set of all means over a ``contamination`` share of the rows.
Every step asks Spark for one corner of that set, the mean of the rows that score
lowest, and the shortest vector over the corners found so far is a small problem on
the driver. The gap between the two is the duality gap, at which the fit stops.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.arrow import row_function
from strayrow.operators.base import RowModel, ThresholdRule
from strayrow.operators.frame import fit_rows
from strayrow.operators.stats import FeatureStats, collect_stats
from strayrow.operators.threshold import contamination_threshold
from strayrow.operators.units import Units, deal
from strayrow.session import spread

KERNELS = ("linear", "poly", "rbf", "sigmoid")
LANDMARKS = 256
# Directions of the landmark kernel below this share of the largest are left out.
FLAT_DIRECTION = 1e-10
QUANTILE_ACCURACY = 10_000
HASH_RANGE = 1 << 40
# Distinct rows whose projections place the bands, and where they lie relative to the share.
SAMPLE_ROWS = 16_384
EDGE_SHARES = (
    0.5, 0.7, 0.8, 0.86, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 1.0,
    1.01, 1.02, 1.03, 1.05, 1.07, 1.1, 1.14, 1.2, 1.3, 1.5, 2.0,
)


@dataclass(frozen=True)
class KernelMap:
    """Features ``K(x, landmarks) @ weights``; the linear kernel uses the row itself."""

    kernel: str
    gamma: float
    coef0: float
    degree: int
    landmarks: np.ndarray
    weights: np.ndarray

    def __call__(self, matrix: np.ndarray) -> np.ndarray:
        if self.kernel == "linear":
            return matrix
        return kernel_values(
            matrix, self.landmarks, self.kernel, self.gamma, self.coef0, self.degree
        ) @ self.weights


def kernel_values(a, b, kernel: str, gamma: float, coef0: float, degree: int) -> np.ndarray:
    product = a @ b.T
    if kernel == "rbf":
        square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * product
        return np.exp(-gamma * np.maximum(square, 0.0))
    if kernel == "poly":
        return (gamma * product + coef0) ** degree
    if kernel == "sigmoid":
        return np.tanh(gamma * product + coef0)
    return product


def cell_variance(units: Units, stats: FeatureStats) -> float:
    """Variance of all cells, about the features' minima; the same bits for every partitioning."""
    width, low = units.width, stats.low

    def add_up(matrix: np.ndarray, copies: np.ndarray, _) -> np.ndarray:
        away = matrix - low
        return np.concatenate([[copies.sum()], copies @ away, copies @ (away * away)])

    total = units.add_up(add_up, 1 + 2 * width)
    mean, square = total[1 : 1 + width] / total[0], total[1 + width :] / total[0]
    var, mean = np.maximum(square - mean * mean, 0.0), mean + low
    return float(var.mean() + ((mean - mean.mean()) ** 2).mean())


def gamma_value(gamma: str | float, units: Units, stats: FeatureStats) -> float:
    """``scale``: one over features times the variance of all cells; ``auto``: one over features."""
    width = len(stats.mean)
    if gamma == "scale":
        every = cell_variance(units, stats)
        return 1.0 / (width * every) if every > 0 else 1.0
    if gamma == "auto":
        return 1.0 / width
    value = float(gamma)
    if value <= 0:
        raise ValueError("gamma must be positive")
    return value


@dataclass(frozen=True)
class OneClassSvm(ThresholdRule, RowModel):
    """The score is the negative projection on the normal, so higher is more anomalous."""

    key = "one_class_svm"
    features: tuple[str, ...]
    map: KernelMap
    normal: np.ndarray
    threshold: float = float("nan")
    # False if the fit ended at ``max_iter`` with the duality gap still above ``tol``.
    converged: bool = True

    def score_column(self, cells: Sequence[Column]) -> Column:
        mapping, normal = self.map, self.normal
        return row_function(lambda matrix: -(mapping(matrix) @ normal), list(cells))

    def state(self):
        m = self.map
        settings = {
            "features": list(self.features),
            "kernel": m.kernel,
            "gamma": m.gamma,
            "coef0": m.coef0,
            "degree": m.degree,
            "threshold": self.threshold,
            "converged": self.converged,
        }
        arrays = {"landmarks": m.landmarks, "weights": m.weights, "normal": self.normal}
        return settings, arrays, {}

    @classmethod
    def restore(cls, settings, arrays, tables):
        named = {k: settings[k] for k in ("kernel", "gamma", "coef0", "degree")}
        mapping = KernelMap(**named, landmarks=arrays["landmarks"], weights=arrays["weights"])
        return cls(
            tuple(settings["features"]),
            mapping,
            arrays["normal"],
            settings["threshold"],
            settings.get("converged", True),
        )


def hashed_rows(
    df: DataFrame, features: Sequence[str], n: int, count: int, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` distinct rows with the smallest feature hash, and how often each occurs.

    All of them, if there are fewer. The hash range that is read is widened until it
    holds enough distinct rows, so the pick depends on the distinct rows alone.
    """
    cells = [F.col(f"`{f}`") for f in features]
    place = F.pmod(F.xxhash64(*cells, F.lit(seed)), F.lit(HASH_RANGE))
    rows = df.select(*cells, place.alias("_h"))
    share = min(1.0, 4 * count / n)
    while True:
        inside = rows.filter(F.col("_h") < F.lit(math.ceil(share * HASH_RANGE)))
        distinct = inside.groupBy("_h", *cells).agg(F.count(F.lit(1)).alias("_n"))
        picked = distinct.orderBy("_h", *cells).limit(count).toPandas()
        if len(picked) == count or share == 1.0:
            # The layout of a stored and loaded model, so that both give the same bits.
            found = np.ascontiguousarray(picked[list(features)].to_numpy(dtype=float))
            return found, picked["_n"].to_numpy(dtype=float)
        share = min(1.0, 64 * share)


def _kernel_map(df, units, features, stats, kernel, gamma, coef0, degree, count, seed) -> KernelMap:
    value = gamma_value(gamma, units, stats)
    if kernel == "linear":
        none = np.zeros((0, 0))
        return KernelMap(kernel, value, coef0, degree, none, none)
    landmarks, _ = hashed_rows(df, features, stats.n, count, seed)
    own = kernel_values(landmarks, landmarks, kernel, value, coef0, degree)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > FLAT_DIRECTION * values.max()
    if not keep.any():
        raise ValueError("the kernel has no positive direction on these rows")
    # A kernel that is not positive definite loses its negative directions here.
    weights = vectors[:, keep] / np.sqrt(values[keep])
    return KernelMap(kernel, value, coef0, degree, landmarks, weights)


def _band_sums(units: Units, mapping: KernelMap, normal, edges: np.ndarray):
    """Per band of projections up to each edge: number of rows and sum of their features."""
    width = len(normal)

    def add_up(matrix: np.ndarray, copies: np.ndarray, _) -> np.ndarray:
        mapped = mapping(matrix)
        band = np.searchsorted(edges, mapped @ normal, side="left")
        # One row per band and a last one for what lies above all edges.
        inside = np.zeros((len(edges) + 1, len(matrix)))
        inside[band, np.arange(len(matrix))] = copies
        return np.column_stack([inside[:-1].sum(axis=1), inside[:-1] @ mapped]).ravel()

    length = len(edges) * (width + 1)
    total = units.add_up(add_up, length).reshape(len(edges), width + 1)
    return total[:, 0], total[:, 1:]


def _lowest_mean(
    units: Units, mapping: KernelMap, normal, share: float, n: int, edges: np.ndarray
) -> tuple[np.ndarray, float] | None:
    """Mean of the mapped rows in the lowest ``share`` of projections on ``normal``.

    Whole bands count fully and the band the share ends in counts in part, which is a
    weighting within the bounds. The second value bounds how much lower the projection
    of the mean would be if that band were taken in order. None if no band reaches the
    share.
    """
    counts, sums = _band_sums(units, mapping, normal, edges)
    wanted = share * n
    upto = np.cumsum(counts)
    reached = np.flatnonzero(upto >= wanted * (1 - 1e-12))
    if not len(reached):
        return None
    at = int(reached[0])
    before = upto[at] - counts[at]
    part = (wanted - before) / counts[at]
    mean = (sums[:at].sum(axis=0) + part * sums[at]) / wanted
    width = edges[at] - edges[at - 1] if at else np.inf
    return mean, part * (1 - part) * counts[at] / wanted * width if part < 1 else 0.0


def _edges(scores: np.ndarray, share: float, copies: np.ndarray | None = None) -> np.ndarray:
    """Band edges around the wanted share, from the projections of sampled rows and their counts."""
    copies = np.ones(len(scores)) if copies is None else copies
    ranks = np.unique(np.minimum(share * np.array(EDGE_SHARES), 1.0))
    order = np.argsort(scores, kind="stable")
    upto = np.cumsum(copies[order])
    at = np.searchsorted(upto, ranks * upto[-1])
    return np.unique(scores[order][np.minimum(at, len(scores) - 1)])


def _exact_edges(rows, features, mapping: KernelMap, normal, share: float) -> np.ndarray:
    """Edges from quantiles of all rows close to the share; equal projections stay in one band."""
    score = row_function(lambda m: mapping(m) @ normal, [F.col(f"`{f}`") for f in features])
    steps = share + np.array([-2, -1, 0, 1, 2, 4]) / QUANTILE_ACCURACY
    ranks = np.unique(np.clip(steps, 0.0, 1.0)).tolist()
    cuts = rows.select(score.alias("s")).agg(
        F.percentile_approx("s", ranks, QUANTILE_ACCURACY).alias("q")
    )
    cuts = np.array(cuts.first()["q"])
    tie = 1e-12 * np.maximum(1.0, np.abs(cuts))
    return np.unique(np.concatenate([cuts - tie, cuts + tie]))


def shortest_in_hull(corners: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights of the shortest vector in the convex hull of the rows (Wolfe 1976)."""
    gram = corners @ corners.T
    scale = max(float(np.abs(gram).max()), 1e-300)
    active = [int(np.argmin(np.diag(gram)))]
    weights = np.zeros(len(corners))
    weights[active] = 1.0
    for _ in range(rounds):
        slope = gram @ weights
        enter = int(np.argmin(slope))
        if weights @ slope - slope[enter] <= 1e-12 * scale or enter in active:
            break
        active.append(enter)
        while True:
            # Shortest point of the affine hull of the active corners.
            size = len(active)
            system = np.ones((size + 1, size + 1))
            system[0, 0] = 0.0
            system[1:, 1:] = gram[np.ix_(active, active)]
            right = np.zeros(size + 1)
            right[0] = 1.0
            target = np.linalg.lstsq(system, right, rcond=None)[0][1:]
            now = weights[active]
            if (target > 0).all():
                weights[:] = 0.0
                weights[active] = target
                break
            falling = target <= 0
            step = np.min(now[falling] / np.maximum(now[falling] - target[falling], 1e-300))
            moved = now + step * (target - now)
            moved[moved <= 1e-15] = 0.0
            weights[:] = 0.0
            weights[active] = moved
            active = [a for a in active if weights[a] > 0]
            if not active:
                active = [int(np.argmin(np.diag(gram)))]
                weights[active] = 1.0
    else:
        warnings.warn(f"the shortest vector was not settled after {rounds} rounds", stacklevel=2)
    return weights / weights.sum()


def fit_plane(
    df: DataFrame,
    features: Sequence[str],
    stats: FeatureStats,
    contamination: float,
    kernel: str = "rbf",
    degree: int = 3,
    gamma: str | float = "scale",
    coef0: float = 0.0,
    tol: float = 1e-3,
    n_landmarks: int = LANDMARKS,
    max_iter: int = 100,
    seed: int = 0,
) -> OneClassSvm:
    """The detector without its threshold. It is the same for every partitioning of ``df``."""
    if not 0.0 < contamination <= 1.0:
        raise ValueError("the one-class machine needs a contamination above 0, up to 1")
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}, choose from {', '.join(KERNELS)}")
    units = deal(df, features, stats.n)
    try:
        mapping = _kernel_map(df, units, features, stats, kernel, gamma, coef0, degree, n_landmarks, seed)
        normal, converged = _shortest_normal(df, units, features, stats, mapping, contamination, tol, max_iter, seed)
    finally:
        units.release()
    if not converged:
        warnings.warn(f"the one-class fit did not reach tol={tol} in {max_iter} steps", stacklevel=2)
    return OneClassSvm(tuple(features), mapping, normal, converged=converged)


def _shortest_normal(
    df: DataFrame, units: Units, features, stats: FeatureStats, mapping: KernelMap, contamination, tol, max_iter, seed
) -> tuple[np.ndarray, bool]:
    """The shortest vector in the set of all means over the share, and whether the gap closed."""
    width = len(features) if mapping.kernel == "linear" else mapping.weights.shape[1]
    # A few rows tell where the bands of the next pass should lie; the pass itself sums
    # over all rows, and falls back to a quantile of all rows where they tell wrong.
    sample, copies = hashed_rows(df, features, stats.n, SAMPLE_ROWS, seed)
    sample = mapping(sample)

    def find_corner(share: float) -> tuple[np.ndarray, float]:
        edges = _edges(sample @ normal, share, copies)
        found = _lowest_mean(units, mapping, normal, share, stats.n, edges)
        if found is not None and found[1] <= 0.5 * tol * (normal @ normal):
            return found
        edges = _exact_edges(df, features, mapping, normal, share)
        return _lowest_mean(units, mapping, normal, share, stats.n, edges)

    normal = np.zeros(width)
    every = np.array([np.inf])
    normal, _ = _lowest_mean(units, mapping, normal, 1.0, stats.n, every)
    corners = normal[None, :]
    for _ in range(max_iter):
        corner, missed = find_corner(contamination)
        gap = normal @ normal - normal @ corner
        allowed = tol * max(normal @ normal, 1e-12)
        if gap <= allowed - min(missed, 0.5 * allowed):
            return normal, True
        corners = np.vstack([corners, corner])
        weights = shortest_in_hull(corners)
        normal = weights @ corners
        # Corners without weight do not come back into the shortest vector's support.
        corners = corners[weights > 0]
    return normal, False


def fit_one_class_svm(
    df: DataFrame,
    features: Sequence[str],
    contamination: float = 0.1,
    kernel: str = "rbf",
    degree: int = 3,
    gamma: str | float = "scale",
    coef0: float = 0.0,
    tol: float = 1e-3,
    n_landmarks: int = LANDMARKS,
    max_iter: int = 100,
    seed: int = 0,
    on_null: str = "error",
) -> OneClassSvm:
    source = fit_rows(df, [], features, on_null)
    stats = collect_stats(source, features)
    rows = spread(source, stats.n).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = fit_plane(
            rows, features, stats, contamination, kernel, degree, gamma, coef0, tol,
            n_landmarks, max_iter, seed,
        )
        scores = rows.select(
            model.score_column([F.col(f"`{f}`") for f in features]).alias("score")
        )
        cut = contamination_threshold(scores, "score", contamination, stats.n)
    finally:
        rows.unpersist()
    return replace(model, threshold=cut)
