"""Per-feature statistics of a table, taken in as few passes as possible."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.functions.arrow import to_lists, to_matrix

# Above this many features the pairwise aggregates no longer fit one generated
# method; blocks of moments merged in Arrow take over.
MAX_PAIRWISE = 12
# Merged blocks that reach the driver, in number and in bytes.
MOST_BLOCKS = 64
BLOCKS_BYTES = 32 << 20


@dataclass(frozen=True)
class FeatureStats:
    """Counts, ranges and moments; ``var`` is the population variance, ``cov`` the sample covariance."""

    n: int
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    cov: np.ndarray | None = None

    def affine(self, shift: np.ndarray, scale: np.ndarray) -> FeatureStats:
        """Statistics of ``(x - shift) / scale``, without reading the table again."""
        cov = None if self.cov is None else self.cov / np.outer(scale, scale)
        return FeatureStats(
            self.n,
            (self.low - shift) / scale,
            (self.high - shift) / scale,
            (self.mean - shift) / scale,
            self.var / scale**2,
            cov,
        )

    def merge(self, other: FeatureStats) -> FeatureStats:
        """Statistics of two tables together, such as those known and a later batch.

        The covariance is kept if both have one.
        """
        if not self.n or not other.n:
            return self if self.n else other
        both = _merged(_Moments.of(self), _Moments.of(other))
        return both.stats(self.cov is not None and other.cov is not None)


@dataclass(frozen=True)
class _Moments:
    """Number, range, mean and summed products of deviations of some rows.

    ``spread`` is a matrix, or its diagonal where covariances aren't asked for.
    """

    n: float
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    @classmethod
    def of(cls, stats: FeatureStats) -> _Moments:
        spread = stats.var * stats.n if stats.cov is None else stats.cov * (stats.n - 1)
        return cls(float(stats.n), stats.low, stats.high, stats.mean, spread)

    @classmethod
    def of_rows(cls, matrix: np.ndarray, with_cov: bool) -> _Moments:
        mean = matrix.mean(axis=0)
        away = matrix - mean
        # What rounding of the mean leaves is taken out of the spread.
        rest = away.sum(axis=0) / len(matrix)
        mean, away = mean + rest, away - rest
        spread = away.T @ away if with_cov else (away * away).sum(axis=0)
        return cls(float(len(matrix)), matrix.min(axis=0), matrix.max(axis=0), mean, spread)

    def flat(self) -> np.ndarray:
        return np.concatenate([[self.n], self.low, self.high, self.mean, self.spread.ravel()])

    @classmethod
    def of_flat(cls, flat: np.ndarray, width: int) -> _Moments:
        low, high, mean = flat[1 : 1 + 3 * width].reshape(3, width)
        rest = flat[1 + 3 * width :]
        return cls(float(flat[0]), low, high, mean, rest.reshape(width, width) if len(rest) != width else rest)

    def stats(self, with_cov: bool) -> FeatureStats:
        square = self.spread.ndim == 2
        var = (np.diag(self.spread) if square else self.spread) / self.n
        cov = self.spread / max(self.n - 1, 1) if with_cov and square else None
        return FeatureStats(int(self.n), self.low, self.high, self.mean, var, cov)


def _merged(a: _Moments, b: _Moments) -> _Moments:
    """Moments of two sets of rows together (Chan, Golub and LeVeque 1979)."""
    n = a.n + b.n
    apart = b.mean - a.mean
    if a.spread.ndim != b.spread.ndim:
        a, b = (_Moments(m.n, m.low, m.high, m.mean, np.diag(m.spread) if m.spread.ndim == 2 else m.spread) for m in (a, b))
    both = np.outer(apart, apart) if a.spread.ndim == 2 else apart * apart
    return _Moments(
        n,
        np.minimum(a.low, b.low),
        np.maximum(a.high, b.high),
        a.mean + apart * (b.n / n),
        a.spread + b.spread + both * (a.n * b.n / n),
    )


def collect_stats(df: DataFrame, features: Sequence[str], with_cov: bool = False) -> FeatureStats:
    """One aggregation over the table, whatever the number of features.

    Rows with a null or NaN in any of the features take no part, whatever their number.
    """
    features = list(features)
    stats = _by_columns if len(features) <= MAX_PAIRWISE else _by_blocks
    cells = df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    result = stats(cells, features, with_cov)
    if result.n == 0:
        raise ValueError("cannot fit on an empty table")
    return result


def _by_columns(df: DataFrame, features: list[str], with_cov: bool) -> FeatureStats:
    d = len(features)
    df = df.dropna()
    cells = [F.col(f"`{f}`") for f in features]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cells):
        aggs += [
            F.min(c).alias(f"lo{i}"),
            F.max(c).alias(f"hi{i}"),
            F.avg(c).alias(f"mu{i}"),
            F.var_pop(c).alias(f"var{i}"),
        ]
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)] if with_cov else []
    aggs += [F.covar_samp(cells[i], cells[j]).alias(f"cov{i}_{j}") for i, j in pairs]
    row = df.agg(*aggs).first()
    n = row["n"]
    if n == 0:
        none = np.zeros(d)
        return FeatureStats(0, none, none, none, none)

    def get(name: str) -> np.ndarray:
        return np.array([row[f"{name}{i}"] for i in range(d)], dtype=float)

    var = get("var")
    cov = None
    if with_cov:
        cov = np.diag(var * (n / (n - 1) if n > 1 else 0.0))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"cov{i}_{j}"] or 0.0
    return FeatureStats(n, get("lo"), get("hi"), get("mu"), var, cov)


def _by_blocks(df: DataFrame, features: list[str], with_cov: bool) -> FeatureStats:
    """Every task merges the moments of its batches; few merged blocks reach the driver.

    Blocks are merged in the order of their tasks, so a rerun gives the same bits. Rows
    with a missing cell are left out there: a condition on every one of many columns
    would keep the optimizer busy for longer than the work takes.
    """
    width = len(features)
    length = 1 + 3 * width + (width * width if with_cov else width)

    def one_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            matrix = to_matrix(batch.column("f"), width)
            matrix = matrix[~np.isnan(matrix).any(axis=1)]
            if len(matrix):
                more = _Moments.of_rows(matrix, with_cov)
                known = more if known is None else _merged(known, more)
        if known is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), to_lists(known.flat()[None, :])], names=["task", "v"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = None, None
        for batch in batches:
            for at, flat in zip(batch.column("task").to_pylist(), to_matrix(batch.column("v"), length)):
                more = _Moments.of_flat(flat, width)
                known, task = (more, at) if known is None else (_merged(known, more), task)
        if known is not None:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), to_lists(known.flat()[None, :])], names=["task", "v"])

    schema = "task long, v array<double>"
    cells = F.array(*[F.col(f"`{f}`") for f in features])
    blocks = df.select(cells.alias("f")).mapInArrow(one_block, schema)
    few = max(4, min(MOST_BLOCKS, BLOCKS_BYTES // (8 * length)))
    blocks = blocks.repartition(few, "task").sortWithinPartitions("task").mapInArrow(put_together, schema)
    rows = blocks.toArrow().sort_by("task")
    if not rows.num_rows:
        none = np.zeros(width)
        return FeatureStats(0, none, none, none, none)
    first, *others = (_Moments.of_flat(v, width) for v in to_matrix(rows["v"], length))
    for more in others:
        first = _merged(first, more)
    return first.stats(with_cov)
