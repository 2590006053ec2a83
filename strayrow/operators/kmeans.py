"""K-Means detector: distance to the own centroid, number of clusters by the elbow."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.functions import columns as fc
from strayrow.functions.arrow import row_function
from strayrow.operators.base import RowModel, ThresholdRule
from strayrow.operators.frame import fit_rows
from strayrow.operators.stats import collect_stats
from strayrow.operators.svm import hashed_rows
from strayrow.operators.threshold import contamination_threshold
from strayrow.operators.units import Places, Units, deal
from strayrow.session import SMALL_ROWS, spread

MAX_EXPRESSION_TERMS = 256
MAX_ITER = 300
# Distance that a centroid may still move when a fit ends.
TOLERANCE = 1e-4
# Distinct rows that tell which rows lie close.
PLACE_ROWS = 1 << 15
# Distinct rows that starts are drawn from, and rows of a work unit: a unit's sums hold all centroids.
START_ROWS = 4096
LLOYD_ROWS = 4096
# Distances of rows to the centroids of one fit held at a time.
STEP_CELLS = 1 << 15
# Rows that lie close and leave out centroids together, and the allowance for rounding there.
BOX_ROWS = 1024
BOX_SLACK = 1e-9


@dataclass(frozen=True)
class KMeansModel(ThresholdRule, RowModel):
    key = "kmeans"
    features: tuple[str, ...]
    centroids: np.ndarray
    threshold: float = float("nan")
    # False if the fit that was kept ended at ``max_iter``.
    converged: bool = True

    @property
    def n_clusters(self) -> int:
        return len(self.centroids)

    def score_column(self, cells: Sequence[Column]) -> Column:
        if self.centroids.size <= MAX_EXPRESSION_TERMS:
            return fc.nearest_centroid_distance(cells, self.centroids)
        centroids = self.centroids

        def distance(matrix: np.ndarray) -> np.ndarray:
            best = np.full(len(matrix), np.inf)
            for centroid in centroids:
                np.minimum(best, ((matrix - centroid) ** 2).sum(axis=1), out=best)
            return np.sqrt(best)

        return row_function(distance, list(cells))

    def state(self):
        settings = {
            "features": list(self.features),
            "threshold": self.threshold,
            "converged": self.converged,
        }
        return settings, {"centroids": self.centroids}, {}

    @classmethod
    def restore(cls, settings, arrays, tables):
        return cls(
            tuple(settings["features"]),
            arrays["centroids"],
            settings["threshold"],
            settings.get("converged", True),
        )


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    cells = [F.col(f"`{f}`").cast("double") for f in features]
    return df.select(array_to_vector(F.array(*cells)).alias("features"))


def _fit(vectors: DataFrame, k: int, seed: int, max_iter: int, n_init: int = 1):
    """The fit of lowest cost among ``n_init`` starts, and whether it converged."""
    starts = [
        KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="features").fit(vectors)
        for i in range(n_init)
    ]
    best = min(starts, key=lambda m: m.summary.trainingCost)
    converged = best.summary.numIter < max_iter
    if not converged:
        warnings.warn(f"K-Means with k={k} did not converge in {max_iter} iterations", stacklevel=3)
    return best, converged


def _single_cluster(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, float]:
    """Centre and inertia for k = 1, which need no iteration: the mean and the total variance."""
    stats = collect_stats(df, features)
    return stats.mean, float(stats.n * stats.var.sum())


def spread_out(rows: np.ndarray, copies: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Up to ``most`` of the rows, one after another, each drawn by its squared distance to those before.

    The first k of them start a fit with k clusters (Arthur and Vassilvitskii 2007).
    """
    rng = np.random.default_rng(seed)
    picked = [int(np.searchsorted(np.cumsum(copies), rng.random() * copies.sum(), side="right"))]
    far = ((rows - rows[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < most and far.any():
        weight = np.cumsum(far * copies)
        at = min(int(np.searchsorted(weight, rng.random() * weight[-1], side="right")), len(rows) - 1)
        picked.append(at)
        np.minimum(far, ((rows - rows[at]) ** 2).sum(axis=1), out=far)
    return rows[picked]


@dataclass
class Fit:
    """One of several fits that step together."""

    k: int
    centroids: np.ndarray
    inertia: float = float("inf")
    counts: np.ndarray | None = None
    iterations: int = 0
    converged: bool = False


def _possible(matrix: np.ndarray, centroids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which centroids can be the nearest of their fit to any of the rows.

    Not those that are farther from the rows' box than another is from its farthest corner.
    """
    low, high = matrix.min(axis=0), matrix.max(axis=0)
    gap = np.maximum(np.maximum(low - centroids, centroids - high), 0.0)
    near = np.einsum("ij,ij->i", gap, gap)
    reach = np.maximum(high - centroids, centroids - low)
    far = np.einsum("ij,ij->i", reach, reach)
    most = np.minimum.reduceat(far, first[:-1])
    # distances are compared in product form, whose rounding follows from the largest of them
    most = most * (1 + BOX_SLACK) + 1e-14 * far.max()
    # a missing cell leaves out nothing
    return ~(near > np.repeat(most, np.diff(first)))


def lloyd(units: Units, fits: Sequence[Fit], max_iter: int = MAX_ITER, tol: float = TOLERANCE) -> None:
    """Move the centroids of all fits to the means of their rows until they rest, one scan a step.

    A step is one aggregation by fit and cluster. Fits that rest take no part in later
    steps. A cluster without rows keeps its centroid. ``tol`` is the distance that a
    centroid may still move; with 0, centroids are exactly the means of their rows.
    """
    width = units.width
    for _ in range(max_iter):
        moving = [f for f in fits if not f.converged]
        if not moving:
            break
        first = np.r_[0, np.cumsum([len(f.centroids) for f in moving])]
        centroids = np.vstack([f.centroids for f in moving])
        # About the middle of the centroids the product form loses few digits.
        middle = centroids.mean(axis=0)
        about = centroids - middle
        table = np.vstack([-2.0 * about.T, (about * about).sum(axis=1)])

        def add_up(matrix: np.ndarray, copies: np.ndarray, _) -> np.ndarray:
            total = np.zeros((len(centroids), width + 1))
            inertia = np.zeros(len(first) - 1)
            possible = _possible(matrix, centroids, first)
            left = np.add.reduceat(possible, first[:-1], dtype=np.int64)
            # All rows of the box go to the only centroid that can be nearest.
            alone = left == 1
            mine = np.flatnonzero(possible & np.repeat(alone, np.diff(first)))
            n, sums = copies.sum(), copies @ matrix
            total[mine, 0], total[mine, 1:] = n, sums
            mean = sums / n
            within = (copies * ((matrix - mean) ** 2).sum(axis=1)).sum()
            inertia[alone] = within + n * ((mean - centroids[mine]) ** 2).sum(axis=1)
            moved = np.column_stack([matrix - middle, np.ones(len(matrix))])
            sums = [copies, *(copies * matrix[:, j] for j in range(width))]
            best = np.empty(len(matrix), dtype=np.int64)
            for i in np.flatnonzero(~alone):
                mine = np.flatnonzero(possible[first[i] : first[i + 1]]) + first[i]
                few = np.ascontiguousarray(table[:, mine])
                # few rows at once, whose distances stay in the cache
                step = max(1, STEP_CELLS // len(mine))
                for start in range(0, len(matrix), step):
                    part = slice(start, start + step)
                    best[part] = (moved[part] @ few).argmin(axis=1)
                for j, values in enumerate(sums):
                    total[mine, j] = np.bincount(best, values, len(mine))
                square = np.zeros(len(matrix))
                for j in range(width):
                    square += (matrix[:, j] - centroids[mine, j].take(best)) ** 2
                inertia[i] = square @ copies
            return np.concatenate([total.ravel(), inertia])

        found = units.add_up(add_up, len(centroids) * (width + 1) + len(moving), None, BOX_ROWS)
        total = found[: -len(moving)].reshape(-1, width + 1)
        for i, fit in enumerate(moving):
            mine = total[first[i] : first[i + 1]]
            counts = mine[:, 0]
            means = np.where(counts[:, None] > 0, mine[:, 1:] / np.maximum(counts, 1)[:, None], fit.centroids)
            moved = np.sqrt(((means - fit.centroids) ** 2).sum(axis=1)).max()
            fit.centroids, fit.counts, fit.inertia = means, counts, float(found[len(found) - len(moving) + i])
            fit.iterations += 1
            fit.converged = bool(moved <= tol)


def fit_every_k(
    df: DataFrame,
    features: Sequence[str],
    ks: Sequence[int],
    seed: int = 0,
    max_iter: int = MAX_ITER,
    n_init: int = 1,
    tol: float = TOLERANCE,
) -> dict[int, Fit]:
    """The best of ``n_init`` fits for every k, all of them stepping together over one dealt table.

    Starts are drawn from up to START_ROWS distinct rows. With fewer distinct rows than
    clusters, every row has a centroid of its own.
    """
    n = df.count()
    if not n:
        raise ValueError("cannot fit on an empty table")
    # In the order of their hashes, so the first of them are a sample too.
    near, copies = hashed_rows(df, features, n, max(START_ROWS, PLACE_ROWS), seed)
    starts = [spread_out(near[:START_ROWS], copies[:START_ROWS], max(ks), seed + i) for i in range(n_init)]
    fits = [Fit(k, start[:k]) for start in starts for k in ks]
    units = deal(df, features, n, rows_per_unit=LLOYD_ROWS, places=Places.of(near))
    try:
        lloyd(units, fits, max_iter, tol)
    finally:
        units.release()
    best: dict[int, Fit] = {}
    for fit in fits:
        if fit.k not in best or fit.inertia < best[fit.k].inertia:
            best[fit.k] = fit
    late = [k for k, fit in best.items() if not fit.converged]
    if late:
        warnings.warn(f"K-Means with k={late[0]} did not converge in {max_iter} iterations", stacklevel=3)
    return best


def curve_of(spark: SparkSession, fits: dict[int, Fit]) -> DataFrame:
    """Table ``(k, score)`` with the negative inertia of every fit."""
    return spark.createDataFrame([(k, -fit.inertia) for k, fit in sorted(fits.items())], "k int, score double")


def elbow_curve(
    df: DataFrame,
    features: Sequence[str],
    max_clusters: int = 100,
    k_values: Sequence[int] | None = None,
    seed: int = 0,
    max_iter: int = MAX_ITER,
    n_init: int = 1,
) -> DataFrame:
    """Table ``(k, score)`` with the negative inertia of a fit for every k below ``max_clusters``."""
    ks = list(k_values) if k_values is not None else list(range(1, max_clusters))
    if not ks:
        raise ValueError("the elbow needs at least one number of clusters")
    return curve_of(df.sparkSession, fit_every_k(df, features, ks, seed, max_iter, n_init))


def elbow_distances(curve: DataFrame) -> DataFrame:
    """Distance of every ``(k, score)`` point to the line from the first to the last score.

    Points stand at x = 0, 1, … from the first k on; the line ends at the number of
    clusters the curve stops before, counted from 1. The ends are single values of an
    aggregate over the short curve.
    """
    ends = curve.agg(
        F.min("k").alias("k1"),
        F.max("k").alias("k2"),
        F.min_by("score", "k").alias("s1"),
        F.max_by("score", "k").alias("s2"),
    ).first()
    distance = fc.point_line_distance(
        F.col("k") - F.lit(float(ends["k1"])),
        F.col("score"),
        F.lit(0.0),
        F.lit(float(ends["s1"])),
        F.lit(float(ends["k2"] - ends["k1"] + 2)),
        F.lit(float(ends["s2"])),
    )
    return curve.select("k", "score", distance.alias("distance"))


def elbow_pick(curve: DataFrame) -> DataFrame:
    """One row with the ``k`` farthest from the line; the smallest of equals."""
    return elbow_distances(curve).agg(
        F.max(F.struct(F.col("distance"), (-F.col("k")).alias("neg"))).alias("best")
    ).select((-F.col("best.neg")).alias("k"), F.col("best.distance").alias("distance"))


def fit_centroids(
    df: DataFrame,
    features: Sequence[str],
    n_clusters: int | None = None,
    max_cluster_elbow: int = 100,
    seed: int = 0,
    max_iter: int = MAX_ITER,
    n_init: int = 1,
) -> KMeansModel:
    """The detector without its threshold."""
    if n_init < 1:
        raise ValueError("n_init must be at least 1")
    if n_clusters is None:
        ks = list(range(1, max_cluster_elbow))
        if not ks:
            raise ValueError("the elbow needs at least one number of clusters")
        fits = fit_every_k(df, features, ks, seed, max_iter, n_init)
        best = fits[elbow_pick(curve_of(df.sparkSession, fits)).first()["k"]]
        return KMeansModel(tuple(features), best.centroids, converged=best.converged)
    if n_clusters < 1:
        raise ValueError("n_clusters must be at least 1")
    if n_clusters == 1:
        return KMeansModel(tuple(features), _single_cluster(df, features)[0][None, :])
    # Spark ML keeps its own copy of the vectors while it iterates.
    model, converged = _fit(_vectors(df, features), n_clusters, seed, max_iter, n_init)
    return KMeansModel(tuple(features), np.array(model.clusterCenters()), converged=converged)


def fit_kmeans(
    df: DataFrame,
    features: Sequence[str],
    n_clusters: int | None = None,
    contamination: float = 0.1,
    max_cluster_elbow: int = 100,
    seed: int = 0,
    max_iter: int = MAX_ITER,
    n_init: int = 1,
    on_null: str = "error",
) -> KMeansModel:
    rows = source = fit_rows(df, [], features, on_null).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = source.count()
        if n > SMALL_ROWS:
            rows = spread(source, n).persist(StorageLevel.MEMORY_AND_DISK)
        model = fit_centroids(rows, features, n_clusters, max_cluster_elbow, seed, max_iter, n_init)
        scores = rows.select(
            model.score_column([F.col(f"`{f}`") for f in features]).alias("score")
        )
        cut = contamination_threshold(scores, "score", contamination)
    finally:
        rows.unpersist()
        source.unpersist()
    return replace(model, threshold=cut)
