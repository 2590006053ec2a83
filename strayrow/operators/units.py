"""Sums over all rows that come out the same however Spark cuts the table.

Iterative fits add up vectors, one for every row, and a sum of doubles depends on its
order. Here rows are dealt to work units by a hash of what they hold, units are added up
in chunks of fixed length in a fixed order, and the units' sums are added in the order of
their numbers. How many partitions, tasks or executors there are has no part in it, so a
fit gives the same bits on a laptop and on a cluster, and after a lost executor.

Where a kernel gains from rows that lie close, units are leaves of a tree over a sample of the rows,
which is fixed by the data too.

Copies of a row are one row with a count, so a value that fills a third of the table
weighs no more on its unit than any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.arrow import FEW_VECTORS, sum_vectors, to_lists, to_matrix
from strayrow.session import Scratch

# Rows aimed at per unit; beyond the largest number of units they grow.
UNIT_ROWS = 2048
MAX_UNITS = 4096
# Rows aimed at per task, unless all cores need more tasks; a task takes several units.
TASK_ROWS = 100_000
# Rows that a kernel gets at once.
CHUNK_ROWS = 4096
# Rows that lie close in a unit, where smaller units would be more than the driver adds up.
CLOSE_ROWS = 65_536
# Sampled rows of a place, and the greatest depth of the tree that leads there.
LEAF_SAMPLE = 8
MAX_DEPTH = 12

# Sum over the rows of a matrix with their numbers of copies; the last argument is the unit and chunk.
Kernel = Callable[[np.ndarray, np.ndarray, tuple[int, int]], np.ndarray]


def number_of_units(n: int, rows_per_unit: int = UNIT_ROWS) -> int:
    return max(1, min(MAX_UNITS, math.ceil(n / rows_per_unit)))


@dataclass(frozen=True)
class Units:
    """Rows ``(part, unit, w, f)``: part of the table, unit, copies and features; written and persisted until release."""

    rows: DataFrame
    width: int
    count: int
    tables: Scratch

    def add_up(
        self, kernel: Kernel, length: int, part: int | None = None, chunk_rows: int | None = CHUNK_ROWS
    ) -> np.ndarray:
        """Sum of ``kernel``, a vector of ``length``, over all rows, or over one part of them.

        The kernel gets ``chunk_rows`` rows at once, or a whole unit with None.
        """
        rows = self.rows if part is None else self.rows.where(F.col("part") == part)
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, None
            for unit, number, x, w in chunks(batches, width, chunk_rows):
                if unit != at:
                    if at is not None:
                        yield _partial(at, total)
                    at, total = unit, np.zeros(length)
                total += kernel(x, w, (unit, number))
            if at is not None:
                yield _partial(at, total)

        partials = rows.select("unit", "w", "f").mapInArrow(run, "unit long, v array<double>")
        return sum_vectors(partials, self.count, length)

    def release(self) -> None:
        self.rows.unpersist()
        self.tables.clear()


def _partial(unit: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), to_lists(total[None, :])], names=["unit", "v"])


def chunks(
    batches: Iterator[pa.RecordBatch], width: int, most: int | None = CHUNK_ROWS
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(unit, number of the chunk, features, copies), ``most`` rows at a time, fewer at a unit's end.

    Rows come sorted by unit; where Arrow cuts them has no effect.
    """
    unit, number, held, size = None, 0, [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([x for x, _ in held]), np.concatenate([w for _, w in held])

    for batch in batches:
        units = batch.column("unit").to_numpy()
        matrix = to_matrix(batch.column("f"), width)
        copies = batch.column("w").to_numpy().astype(np.float64)
        cuts = np.flatnonzero(np.diff(units)) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(units)], strict=True):
            if a == b:
                continue
            if units[a] != unit:
                if size:
                    yield unit, number, *joined()
                unit, number, held, size = int(units[a]), 0, [], 0
            held.append((matrix[a:b], copies[a:b]))
            size += b - a
            while most is not None and size >= most:
                x, w = joined()
                yield unit, number, x[:most], w[:most]
                number += 1
                held, size = [(x[most:], w[most:])], size - most
    if size:
        yield unit, number, *joined()


@dataclass(frozen=True)
class Places:
    """A binary tree over a sample of rows: each node cuts the widest feature at its median."""

    axis: np.ndarray
    cut: np.ndarray
    depth: int

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    @classmethod
    def of(cls, sample: np.ndarray) -> Places:
        depth = max(0, min(MAX_DEPTH, int(math.log2(max(len(sample) / LEAF_SAMPLE, 1)))))
        axis, cut = np.zeros((1 << depth) - 1, dtype=np.int64), np.full((1 << depth) - 1, np.inf)
        held = {0: sample}
        for node in range(len(axis)):
            x = held.pop(node)
            if len(x):
                axis[node] = at = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
                cut[node] = np.median(x[:, at])
            right = x[:, axis[node]] > cut[node]
            held[2 * node + 1], held[2 * node + 2] = x[~right], x[right]
        return cls(axis, cut, depth)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.axis[node]] > self.cut[node])
        return node - len(self.axis)

    def add(self, rows: DataFrame) -> DataFrame:
        """The rows ``(..., f)`` with the leaf of each as ``place``."""
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    f = batch.column("f")
                    leaf = self.leaf(to_matrix(f, len(f.flatten()) // len(f)))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "place"])

        fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
        return rows.mapInArrow(place, f"{fields}, place long")


def deal(
    df: DataFrame,
    features: Sequence[str],
    n: int,
    part: Column | None = None,
    parts: int = 1,
    also: Sequence[Column] = (),
    rows_per_unit: int = UNIT_ROWS,
    count: int | None = None,
    most: int | None = None,
    places: Places | None = None,
) -> Units:
    """The rows of ``df`` in units, persisted. ``n`` is their number.

    ``part`` cuts the table in ``parts`` that are added up one by one; every part is
    spread over all units. ``also`` tells rows apart that hold equal features. ``count`` is the
    number of units, if it does not follow from ``rows_per_unit``. A row with over ``most`` copies
    becomes several, in units of their own. With ``places``, units hold rows that lie close,
    in that order, and their number follows from the distinct rows.
    """
    count = count or number_of_units(math.ceil(n / parts), rows_per_unit)
    f = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    keys = [f"k{i}" for i in range(len(also))]
    rows = df.select(
        (F.lit(0) if part is None else part).cast("int").alias("part"), f.alias("f"), *[c.alias(k) for c, k in zip(also, keys)]
    )
    rows = rows.groupBy("part", "f", *keys).agg(F.count(F.lit(1)).alias("w"))
    if most is not None:
        piece = F.explode(F.sequence(F.lit(0), F.ceil(F.col("w") / most) - 1))
        rows = rows.withColumn("piece", piece).withColumn("w", F.least(F.lit(most), F.col("w") - F.col("piece") * most))
        keys = [*keys, "piece"]
    if places is None:
        rows = rows.withColumn("unit", F.pmod(F.xxhash64("f", *keys), F.lit(count)))
    # Written once: a fit asks for many passes, and each would plan all that lies before.
    tables = Scratch(df.sparkSession)
    rows = tables(rows, "units")
    if places is not None:
        n = rows.count()
        each = max(rows_per_unit, min(CLOSE_ROWS, math.ceil(n / FEW_VECTORS)))
        # The units of a leaf, or the leaves of a unit.
        count = number_of_units(n, each)
        split = math.ceil(count / places.leaves)
        count = count if split == 1 else split * places.leaves
        first = F.floor(F.col("place") * count / places.leaves)
        rows = places.add(rows).withColumn("unit", (first + F.pmod(F.xxhash64("f"), F.lit(split))).cast("long"))
    # Sorted by part, so that a pass over one of them skips the stored batches of the others.
    cores = df.sparkSession.sparkContext.defaultParallelism
    if places is None:
        tasks = min(count, max(cores, math.ceil(n / TASK_ROWS)))
        rows = rows.repartition(tasks, "unit").sortWithinPartitions("part", "unit", "f", *keys)
    else:
        # Units differ in their work, so tasks get as many of them each, and there are some to spare.
        tasks = min(count, max(4 * cores, math.ceil(n / TASK_ROWS)))
        rows = rows.repartitionByRange(tasks, "unit").sortWithinPartitions("part", "unit", "place", "f", *keys)
    return Units(rows.select("part", "unit", "w", "f").persist(StorageLevel.MEMORY_AND_DISK), len(features), count, tables)
