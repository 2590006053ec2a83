"""Contamination thresholds: exact percentiles of training scores at any table size."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("exact", "refine", "approx")
# Up to this many rows the built-in exact percentile is used: it keeps every
# distinct value in the memory of one task, which is only safe for a known count.
# Refinement interpolates with the same arithmetic, so this only chooses a plan.
PERCENTILE_ROWS = 1_000_000
# Buckets per refinement step, and the size at which a bucket's values are fetched.
BUCKETS = 4096
FETCH_ROWS = 10_000
# Buckets per power of two in the first step.
LOG_STEPS = 8
LOG_OFFSET = 16_384
# Beyond the buckets of all finite values.
INFINITE = 1 << 40


def quantiles(
    df: DataFrame,
    probabilities: Mapping[str, float],
    n: int | None = None,
    method: str = "exact",
    accuracy: int = 10_000,
    weight: str | None = None,
) -> dict[str, float]:
    """Linearly interpolated quantile of each given score column, nulls left out.

    ``probabilities`` maps column names to a probability. ``method="approx"`` takes
    one pass with a bounded sketch, ``"exact"`` gives the interpolated order
    statistics, with the built-in percentile for a small table and by refinement for
    a large one; ``"refine"`` always refines. ``n`` is the row count if known. ``weight`` names a
    column with the number of times a row counts (exact method only).
    """
    if weight is not None and method == "approx":
        raise ValueError("weights need the exact method")
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    for q in probabilities.values():
        if not 0.0 <= q <= 1.0:
            raise ValueError("a probability lies between 0 and 1")
    if method == "approx":
        row = df.agg(
            *[
                F.percentile_approx(F.col(c), q, accuracy).alias(c)
                for c, q in probabilities.items()
            ]
        ).first()
        return {c: row[c] for c in probabilities}
    if method == "exact" and n is None:
        n = df.count()
    if method == "exact" and n <= PERCENTILE_ROWS:
        copies = F.lit(1) if weight is None else F.col(weight)
        aggs = [F.percentile(F.col(c), q, copies).alias(c) for c, q in probabilities.items()]
        values = df.agg(*aggs).first()
        return {c: values[c] for c in probabilities}
    return _by_refinement(df, probabilities, weight)


def contamination_threshold(
    df: DataFrame,
    score: str,
    contamination: float,
    n: int | None = None,
    method: str = "exact",
    accuracy: int = 10_000,
    weight: str | None = None,
) -> float:
    """Score that the given share of the training rows exceeds."""
    check_contamination(contamination)
    return quantiles(df, {score: 1.0 - contamination}, n, method, accuracy, weight)[score]


def check_contamination(contamination: float) -> None:
    if not 0.0 <= contamination <= 1.0:
        raise ValueError("contamination lies between 0 and 1")


def _by_refinement(
    df: DataFrame, probabilities: Mapping[str, float], weight: str | None
) -> dict[str, float]:
    """Order statistics by narrowing histograms, one bounded aggregation per step.

    Every step counts buckets (combined before the shuffle) and goes on inside the
    bucket that holds the wanted rank, so no task ever holds many values.
    """
    names = list(probabilities)
    kept = df.select(*names, *([weight] if weight else []))
    if df.storageLevel.useMemory or df.storageLevel.useDisk:
        return _refine(kept, probabilities, weight)
    kept = kept.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _refine(kept, probabilities, weight)
    finally:
        kept.unpersist()


def _refine(
    df: DataFrame, probabilities: Mapping[str, float], weight: str | None
) -> dict[str, float]:
    names = list(probabilities)
    copies = (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("w")
    long = df.select(
        copies,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in names])
        ).alias("s"),
    ).select("s.name", "s.x", "w")
    long = long.filter("x IS NOT NULL AND NOT isnan(x)")
    rows = (
        long.groupBy("name", _log_bucket(F.col("x")).alias("bucket"))
        .agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .collect()
    )
    result = {}
    for name, q in probabilities.items():
        buckets = sorted((r["lo"], r["hi"], r["n"]) for r in rows if r["name"] == name)
        total = sum(b[2] for b in buckets)
        if total == 0:
            result[name] = None
            continue
        position = (total - 1) * q
        rank = math.floor(position)
        share = position - rank
        values = df.select(F.col(name).alias("x"), copies).filter("x IS NOT NULL AND NOT isnan(x)")
        low = _order_statistic(values, buckets, rank)
        high = low if share == 0 else _order_statistic(values, buckets, rank + 1)
        result[name] = low if low == high else (rank + 1 - position) * low + share * high
    return result


def _log_bucket(x: Column) -> Column:
    """Integer that never decreases with ``x``: signed steps of the binary logarithm.

    An infinity has a bucket of its own, so refinement never divides its width.
    """
    infinite = F.lit(float("inf"))
    step = F.floor(F.log2(F.abs(x)) * LOG_STEPS) + LOG_OFFSET
    ends = F.when(x == infinite, INFINITE).when(x == -infinite, -INFINITE)
    return ends.when(x > 0, step).when(x < 0, -step).otherwise(F.lit(0)).cast("long")


def _order_statistic(values: DataFrame, buckets: list[tuple], rank: int) -> float:
    while True:
        lo, hi, n = buckets[0]
        for lo, hi, n in buckets:
            if rank < n:
                break
            rank -= n
        if lo == hi or rank == 0:
            return lo
        if rank == n - 1:
            return hi
        inside = values.filter(F.col("x").between(lo, hi))
        if n <= FETCH_ROWS:
            for x, w in sorted((r["x"], r["w"]) for r in inside.collect()):
                if rank < w:
                    return x
                rank -= w
        width = hi - lo
        cut = F.floor((F.col("x") - F.lit(lo)) / F.lit(width) * BUCKETS)
        rows = (
            inside.groupBy(cut.alias("bucket"))
            .agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .collect()
        )
        buckets = sorted((r["lo"], r["hi"], r["n"]) for r in rows)
