"""Short codes of wide vectors, with exact bounds on their distances.

A vector is turned onto orthonormal axes; its code holds its places on the leading ones
and the length of what is left. For two vectors x and y with rests r and s

    |code(x) - code(y)| <= |x - y| <= sqrt(|code(x) - code(y)|^2 + 4 r s)

holds in the Euclidean norm, whatever the axes, so codes can be searched and moved
instead of vectors, and only what the lower bound lets through needs whole vectors. The
axes follow the largest variances of a bounded sample; that choice decides how much the
bounds exclude, not whether they hold. Other Minkowski norms are between constant
multiples of the Euclidean one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strayrow.functions.arrow import to_lists, to_matrix

# Share of the sample's variance that the leading axes aim at, and the share of the width they may take.
VARIANCE = 0.9
MAX_SHARE = 0.25


@dataclass(frozen=True)
class Axes:
    """Centre, leading axes as columns, and the order of the distance that is asked for."""

    centre: np.ndarray
    axes: np.ndarray
    order: float

    @property
    def width(self) -> int:
        """Numbers in a code."""
        return self.axes.shape[1] + 1

    @property
    def factors(self) -> tuple[float, float]:
        """(a, b) with a * Euclidean <= asked distance <= b * Euclidean."""
        ratio = len(self.centre) ** (1.0 / self.order - 0.5)
        return (1.0, ratio) if self.order <= 2 else (ratio, 1.0)

    def code(self, matrix: np.ndarray) -> np.ndarray:
        moved = matrix - self.centre
        front = moved @ self.axes
        rest = moved - front @ self.axes.T
        return np.column_stack([front, np.sqrt((rest * rest).sum(axis=1))])

    def least(self, code_distance):
        """Lower bound of the distance from that of the codes."""
        return self.factors[0] * code_distance

    def code_bound(self, bound):
        """The distance of codes beyond which no vector lies within ``bound``."""
        return bound / self.factors[0]

    def most(self, code_distance, rest, other_rest):
        """Upper bound of the distance from that of the codes and the two rests."""
        return self.factors[1] * np.sqrt(code_distance**2 + 4.0 * rest * other_rest)


def choose_axes(sample: np.ndarray, order: float) -> Axes:
    """The axes of largest variance in the sample, as many as VARIANCE asks for within MAX_SHARE."""
    width = sample.shape[1]
    centre = sample.mean(axis=0)
    moved = sample - centre
    values, vectors = np.linalg.eigh(moved.T @ moved)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    total = values.sum()
    enough = int(np.searchsorted(np.cumsum(values), VARIANCE * total)) + 1 if total > 0 else 1
    n = max(1, min(enough, int(MAX_SHARE * width)))
    return Axes(centre, np.ascontiguousarray(vectors[:, :n]), order)


def with_codes(df: DataFrame, axes: Axes) -> DataFrame:
    """The rows with their vector as ``full`` and its code as ``f``."""
    kept = [c for c in df.columns if c != "f"]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    width = len(axes.centre)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = batch.column("f")
            code = to_lists(axes.code(to_matrix(full, width)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), full, code], names=[*kept, "full", "f"])

    return df.mapInArrow(encode, f"{fields + ', ' if fields else ''}full array<double>, f array<double>")
