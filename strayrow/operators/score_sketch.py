"""Cuts from a sketch of the training scores that later batches are merged into.

The exact cut needs all scores again whenever rows are added. A KLL sketch holds a few
thousand of them, chosen so that every rank is known up to a small share of all, and two
sketches merge into that of both sets. Kept beside a model, it lets new rows move the
cut without reading the old ones. The aggregation and the merge are Spark's own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.operators.threshold import check_contamination

# Size of the sketch; ranks are then right up to RANK_ERROR of the rows, but for a chance below 1 %.
SIZE = 4096
RANK_ERROR = 0.001


@dataclass(frozen=True)
class ScoreSketch:
    """A sketch of ``n`` scores."""

    cells: bytes
    n: int

    @property
    def rank_error(self) -> int:
        """By how many rows the rank of a cut may be off; a small set is held whole."""
        return 0 if self.n <= SIZE else int(RANK_ERROR * self.n) + 1


def sketch_column(score: Column) -> Column:
    """Aggregate: the sketch of a score column, nulls and NaN left out. Usable with groupBy."""
    return F.kll_sketch_agg_double(F.when(~F.isnan(score), score), F.lit(SIZE))


def _read(row) -> ScoreSketch:
    return ScoreSketch(bytes(row["s"]), int(row["n"]))


def sketch_scores(df: DataFrame, score: str) -> ScoreSketch:
    """One pass over the scores; partitions send sketches, not scores."""
    sketch = df.agg(sketch_column(F.col(f"`{score}`")).alias("s"))
    return _read(sketch.select("s", F.kll_sketch_get_n_double("s").alias("n")).first())


def merged(spark: SparkSession, sketches: Sequence[ScoreSketch]) -> ScoreSketch:
    """The sketch of all sets of scores together."""
    if not sketches:
        raise ValueError("nothing to merge")
    rows = spark.createDataFrame([(bytearray(s.cells),) for s in sketches], "s binary")
    return merged_column(rows, "s")


def merged_column(rows: DataFrame, column: str) -> ScoreSketch:
    """The sketch of all sketches in a column, such as one for each day."""
    sketch = rows.agg(F.kll_merge_agg_double(F.col(f"`{column}`"), F.lit(SIZE)).alias("s"))
    return _read(sketch.select("s", F.kll_sketch_get_n_double("s").alias("n")).first())


def cut(spark: SparkSession, sketch: ScoreSketch, contamination: float) -> float:
    """The score that about the given share of the scores exceeds."""
    check_contamination(contamination)
    if not sketch.n:
        raise ValueError("a sketch without scores has no cut")
    row = spark.createDataFrame([(bytearray(sketch.cells),)], "s binary")
    return float(row.select(F.kll_sketch_get_quantile_double("s", F.lit(1.0 - contamination)).alias("q")).first()["q"])
