"""Gaussian density detector and the search for its probability cut."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strayrow.functions import columns as fc
from strayrow.operators.base import RowModel
from strayrow.operators.frame import fit_rows
from strayrow.operators.stats import FeatureStats, collect_stats

EPSILON_CANDIDATES = 100_000_000
# The grid is cut into this many runs of candidates for the running counts.
GRID_RUNS = 4096


@dataclass(frozen=True)
class Gaussian(RowModel):
    """Independent normal densities; the score is the probability, rows below epsilon are flagged."""

    key = "gaussian_distribution"
    features: tuple[str, ...]
    mean: np.ndarray
    var: np.ndarray
    epsilon: float = float("nan")

    def log_score_column(self, cells: Sequence[Column]) -> Column:
        return fc.log_density(cells, self.mean, self.var)

    def score_column(self, cells: Sequence[Column]) -> Column:
        return F.exp(self.log_score_column(cells))

    def flag_column(self, score: Column) -> Column:
        return score < F.lit(float(self.epsilon))

    def state(self):
        arrays = {"mean": self.mean, "var": self.var}
        return {"features": list(self.features), "epsilon": self.epsilon}, arrays, {}

    @classmethod
    def restore(cls, settings, arrays, tables):
        return cls(tuple(settings["features"]), **arrays, epsilon=settings["epsilon"])


def from_stats(stats: FeatureStats, features: Sequence[str]) -> Gaussian:
    """The density without its cut."""
    flat = [f for f, v in zip(features, stats.var) if not v > 0]
    if flat:
        raise ValueError(f"no density for features without variance: {', '.join(flat)}")
    return Gaussian(tuple(features), stats.mean, stats.var)


def epsilon_unlabelled(low: float, high: float, candidates: int) -> float:
    """Without known anomalies the cut lies one grid step above the lowest probability."""
    return low + (high - low) / candidates


def confusion(df: DataFrame, probability: str, label: str, epsilon: float) -> DataFrame:
    """Counts and rates of the rule ``probability < epsilon`` against 0/1 labels."""
    hit = F.col(probability) < F.lit(float(epsilon))
    positive = F.col(label) == 1
    counts = df.agg(
        F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & positive).alias("fn"),
        F.count_if(hit & positive).alias("tp"),
    )
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.select(
        "fp", "fn", "tp", precision.alias("precision"), recall.alias("recall")
    ).withColumn(
        "f1",
        F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )


def search_epsilon(
    df: DataFrame, probability: str, label: str | None, candidates: int = EPSILON_CANDIDATES
) -> tuple[float, float]:
    """Cut and its F1 score.

    The candidates form a linear grid over the range of the probabilities. A row is
    flagged by every candidate from the first one above its probability on, so it
    is enough to count labels per such first candidate and to run those counts up:
    one aggregation instead of a pass per candidate.
    """
    if candidates < 1:
        raise ValueError("epsilon_candidates must be at least 1")
    p = F.col(probability)
    positive = F.lit(0) if label is None else F.when(F.col(label) == 1, 1).otherwise(0)
    row = df.agg(
        F.min(p).alias("lo"), F.max(p).alias("hi"), F.sum(positive).alias("pos")
    ).first()
    lo, hi, total = row["lo"], row["hi"], row["pos"]
    if lo is None:
        raise ValueError("cannot search on an empty table")
    step = (hi - lo) / candidates
    if not total:
        return epsilon_unlabelled(lo, hi, candidates), 1.0
    if step == 0:
        return lo, 0.0

    def epsilon(i: Column) -> Column:
        return F.lit(lo) + i * F.lit(step)

    guess = F.floor((p - F.lit(lo)) / F.lit(step)).cast("long")
    first = F.coalesce(
        *[F.when(epsilon(guess + d) > p, guess + d) for d in (-1, 0, 1)], guess + 2
    )
    run_length = math.ceil(candidates / GRID_RUNS)
    counts = (
        df.filter(p.isNotNull())
        .select(first.alias("i"), positive.alias("y"))
        .filter(F.col("i") < candidates)
        .groupBy("i")
        .agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
        .withColumn("run", F.expr(f"i div {run_length}"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        # At most GRID_RUNS totals: they give every run the counts before it.
        totals = counts.groupBy("run").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).collect()
        before, offsets = (0, 0), []
        for r in sorted(totals, key=lambda r: r["run"]):
            offsets.append((r["run"], *before))
            before = (before[0] + r["pos"], before[1] + r["n"])
        if not offsets:
            return 0.0, 0.0
        start = df.sparkSession.createDataFrame(offsets, "run long, pos0 long, n0 long")
        upto = "OVER (PARTITION BY run ORDER BY i ROWS UNBOUNDED PRECEDING)"
        running = counts.join(F.broadcast(start), "run").select(
            "i",
            F.expr(f"pos0 + sum(pos) {upto}").alias("tp"),
            F.expr(f"n0 + sum(n) {upto}").alias("flagged"),
        )
        precision = F.col("tp") / F.col("flagged")
        recall = F.col("tp") / F.lit(total)
        best = (
            running.filter("tp > 0")
            .select("i", precision.alias("p"), recall.alias("r"))
            .select("i", (2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).alias("f1"))
            .agg(F.max(F.struct("f1", (-F.col("i")).alias("neg"))).alias("best"))
            .first()["best"]
        )
    finally:
        counts.unpersist()
    if best is None:
        return 0.0, 0.0
    return lo + (-best["neg"]) * step, best["f1"]


def with_epsilon(model: Gaussian, epsilon: float) -> Gaussian:
    return replace(model, epsilon=epsilon)


def fit_gaussian(
    df: DataFrame,
    features: Sequence[str],
    label_col: str | None = None,
    epsilon_candidates: int = EPSILON_CANDIDATES,
    on_null: str = "error",
) -> Gaussian:
    keep = [] if label_col is None else [label_col]
    rows = fit_rows(df, keep, features, on_null)
    model = from_stats(collect_stats(rows, features), features)
    scored = rows.select(*keep, model.score_column([F.col(f"`{f}`") for f in features]).alias("p"))
    if label_col is not None:
        # With labels the probabilities are read twice; without, once.
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        epsilon, _ = search_epsilon(scored, "p", label_col, epsilon_candidates)
    finally:
        scored.unpersist()
    return with_epsilon(model, epsilon)
