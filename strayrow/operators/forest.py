"""Isolation forest (Liu, Ting and Zhou 2008): small sampled trees, built in parallel groups."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions.arrow import row_function
from strayrow.operators.base import RowModel, ThresholdRule
from strayrow.operators.frame import as_list, fit_rows
from strayrow.operators.threshold import contamination_threshold
from strayrow.session import spread

SAMPLE_ROWS = 256
EULER_GAMMA = 0.5772156649015329
# Expected rows drawn per tree, relative to what a tree takes, so that none falls short.
OVERDRAW = 1.5
HASH_RANGE = 1 << 60

NODE_SCHEMA = (
    "tree int, node int, feature int, cut double, left int, right int, path double"
)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


@dataclass(frozen=True)
class IsolationForest(ThresholdRule, RowModel):
    """Nodes of all trees side by side; ``left`` and ``right`` are positions, leaves point to themselves."""

    key = "isolation_forest"
    features: tuple[str, ...]
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    sample_rows: int
    threshold: float = float("nan")

    def score_column(self, cells: Sequence[Column]) -> Column:
        roots, feature, cut, path = self.roots, self.feature, self.cut, self.path
        children = np.ravel(np.column_stack([self.left, self.right]))
        scale = max(float(average_path(self.sample_rows)), 1e-300) * len(roots)
        depth = max(1, math.ceil(math.log2(max(self.sample_rows, 2))))

        def score(matrix: np.ndarray) -> np.ndarray:
            total = np.zeros(len(matrix))
            cells, width = np.ravel(matrix), matrix.shape[1]
            first_cell = np.arange(len(matrix)) * width
            for root in roots:
                at = np.full(len(matrix), root)
                for _ in range(depth):
                    goes_right = cells.take(first_cell + feature.take(at)) > cut.take(at)
                    at = children.take(2 * at + goes_right)
                total += path.take(at)
            return np.exp2(-total / scale)

        return row_function(score, list(cells))

    def state(self):
        settings = {
            "features": list(self.features),
            "sample_rows": self.sample_rows,
            "threshold": self.threshold,
        }
        arrays = {
            name: getattr(self, name)
            for name in ("roots", "feature", "cut", "left", "right", "path")
        }
        return settings, arrays, {}

    @classmethod
    def restore(cls, settings, arrays, tables):
        whole = {n: arrays[n].astype(np.int64) for n in ("roots", "feature", "left", "right")}
        return cls(
            tuple(settings["features"]),
            **whole,
            cut=arrays["cut"],
            path=arrays["path"],
            sample_rows=settings["sample_rows"],
            threshold=settings["threshold"],
        )


def feature_count(max_features: int | float, width: int) -> int:
    """Features a tree may split on: a whole number of them, or a share of all."""
    if isinstance(max_features, bool) or max_features <= 0:
        raise ValueError("max_features must be positive")
    if isinstance(max_features, int):
        if max_features > width:
            raise ValueError(f"max_features is {max_features}, but there are {width} features")
        return max_features
    if max_features > 1.0:
        raise ValueError("a share of features lies between 0 and 1")
    return max(1, int(max_features * width))


def _distinct_ids(df: DataFrame, ids: list[str], n: int) -> int:
    """About how many ids the table has, rather too few; exactly ``n`` if they hardly repeat.

    The estimate is the same for every partitioning.
    """
    about = df.agg(F.approx_count_distinct(F.xxhash64(*ids), 0.02).alias("d")).first()["d"]
    return n if about >= 0.9 * n else max(1, int(0.95 * about))


def _draw(df: DataFrame, ids: list[str], features: list[str], n: int, n_trees: int, size: int, seed: int) -> DataFrame:
    """``tree``, ``_h`` and the feature columns of the rows each tree is built from, and some more.

    Hashes of the id decide, so the sample does not depend on partitions: a tree takes
    the ids of smallest ``_h``. Ids are dealt in rounds: each deals disjoint shares of
    them to as many trees as there are ids for, and every round has a hash of its own. A
    table with ids for all trees needs one round, one with too few ids for two trees a
    round for each tree. Shares are a little larger than a sample, and only what is
    inside them is multiplied. Rows of one id meet before the shuffle and leave one row,
    the least, so an id that many rows hold takes one place and fills no task.
    """
    wanted = math.ceil(OVERDRAW * size + 64)
    known = _distinct_ids(df, ids, n)
    in_round = max(1, min(n_trees, known // wanted))
    share = HASH_RANGE * min(known, wanted) // known

    def dealt(deal: Column) -> Column:
        """The tree an id goes to in this round; numbers from ``n_trees`` on are none."""
        at = F.floor(F.pmod(F.xxhash64(*ids, F.lit(seed), deal), F.lit(HASH_RANGE)) / share)
        tree = (deal * in_round + at).cast("int")
        return F.when(at < in_round, tree).otherwise(n_trees)

    rounds = F.sequence(F.lit(0), F.lit((n_trees - 1) // in_round))
    trees = F.filter(F.transform(rounds, dealt), lambda t: t < n_trees)
    cells = F.struct(*[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    drawn = df.select(*ids, cells.alias("cells"), F.explode(trees).alias("tree"))
    h = F.xxhash64(*ids, F.lit(seed + 1), F.col("tree")).alias("_h")
    one = drawn.select("tree", h, F.to_json(F.struct(*ids)).alias("_id"), "cells").groupBy("tree", "_h", "_id").agg(F.min("cells").alias("cells"))
    return one.select("tree", "_h", "_id", *[F.col(f"cells.f{i}").alias(f) for i, f in enumerate(features)])


def _with_replacement(matrix: np.ndarray, n: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """``size`` draws with replacement from a table of ``n`` rows.

    The matrix has different rows of the table in random order. They stand in for the
    distinct rows of the draw, with its multiplicities.
    """
    times = np.unique(rng.integers(0, n, size), return_counts=True)[1][: len(matrix)]
    return np.repeat(matrix[: len(times)], times, axis=0)


def _grow(matrix: np.ndarray, columns: np.ndarray, height: int, rng: np.random.Generator) -> list:
    """Nodes ``(feature, cut, left, right, path)`` of one tree, the root first."""
    nodes: list[list] = []

    def add(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([0, 0.0, me, me, depth + float(average_path(len(rows)))])
        if depth >= height or len(rows) <= 1:
            return me
        low, high = matrix[rows].min(axis=0), matrix[rows].max(axis=0)
        usable = columns[high[columns] > low[columns]]
        if not len(usable):
            return me
        j = int(rng.choice(usable))
        cut = float(rng.uniform(low[j], high[j]))
        if cut >= high[j]:
            cut = float(low[j])
        side = matrix[rows, j] <= cut
        nodes[me][0], nodes[me][1] = j, cut
        nodes[me][2] = add(rows[side], depth + 1)
        nodes[me][3] = add(rows[~side], depth + 1)
        return me

    add(np.arange(len(matrix)), 0)
    return nodes


def fit_trees(
    df: DataFrame,
    features: Sequence[str],
    id_col: str | Sequence[str],
    n: int,
    n_estimators: int = 100,
    max_features: int | float = 1.0,
    bootstrap: bool = False,
    seed: int = 0,
) -> IsolationForest:
    """The forest without its threshold."""
    features, ids = list(features), as_list(id_col)
    width = feature_count(max_features, len(features))
    size = min(SAMPLE_ROWS, n)
    height = max(1, math.ceil(math.log2(max(size, 2))))

    def build(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        group = group.sort_values(["_h", "_id"]).head(size)
        matrix = group[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        if bootstrap:
            matrix = _with_replacement(matrix, n, size, rng)
        columns = np.sort(rng.choice(len(features), width, replace=False))
        nodes = _grow(matrix, columns, height, rng)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        return out

    drawn = _draw(df, ids, features, n, n_estimators, size, seed)
    # One group holds the rows of one tree, little more than SAMPLE_ROWS; all trees together
    # have fewer than 2 * SAMPLE_ROWS * n_estimators nodes.
    nodes = (
        drawn.groupBy("tree")
        .applyInPandas(build, NODE_SCHEMA)
        .toPandas()
        .sort_values(["tree", "node"])
        .reset_index(drop=True)
    )
    starts = nodes.index[nodes["node"] == 0].to_numpy()
    base = np.repeat(starts, np.diff(np.r_[starts, len(nodes)]))
    return IsolationForest(
        tuple(features),
        roots=starts,
        feature=nodes["feature"].to_numpy(dtype=np.int64),
        cut=nodes["cut"].to_numpy(),
        left=nodes["left"].to_numpy(dtype=np.int64) + base,
        right=nodes["right"].to_numpy(dtype=np.int64) + base,
        path=nodes["path"].to_numpy(),
        sample_rows=size,
    )


def fit_isolation_forest(
    df: DataFrame,
    features: Sequence[str],
    id_col: str | Sequence[str],
    contamination: float = 0.1,
    n_estimators: int = 100,
    max_features: int | float = 1.0,
    bootstrap: bool = False,
    seed: int = 0,
    on_null: str = "error",
) -> IsolationForest:
    rows = fit_rows(df, as_list(id_col), features, on_null)
    n = rows.count()
    if n == 0:
        raise ValueError("cannot fit on an empty table")
    rows = spread(rows, n)
    model = fit_trees(rows, features, id_col, n, n_estimators, max_features, bootstrap, seed)
    scores = rows.select(model.score_column([F.col(f"`{f}`") for f in features]).alias("score"))
    return replace(model, threshold=contamination_threshold(scores, "score", contamination, n))
