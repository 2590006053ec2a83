"""Detector on the distances to the k nearest training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strayrow.functions import columns as fc
from strayrow.operators import neighbours as nn
from strayrow.operators.base import JoinModel, ThresholdRule
from strayrow.operators.frame import as_list, fit_rows
from strayrow.operators.threshold import contamination_threshold


@dataclass(frozen=True)
class KNearest(ThresholdRule, JoinModel):
    key = "knearest_neighbors"
    index: nn.PointIndex
    n_neighbors: int
    score_func: str
    threshold: float
    method: str = "auto"

    @property
    def features(self) -> tuple[str, ...]:
        return self.index.features

    def add_score(self, found: DataFrame, ids: Sequence[str], name: str) -> DataFrame:
        score = fc.neighbour_score(nn.distances(), self.n_neighbors, self.score_func)
        return found.withColumn(name, score)

    def state(self):
        settings = {
            "features": list(self.features),
            "n_neighbors": self.n_neighbors,
            "score_func": self.score_func,
            "threshold": self.threshold,
            "method": self.method,
            "order": self.index.order,
        }
        return settings, {}, {"points": self.index.points}

    @classmethod
    def restore(cls, settings, arrays, tables):
        index = nn.index_of_points(tables["points"], settings["features"], settings["order"])
        return cls(
            index,
            settings["n_neighbors"],
            settings["score_func"],
            settings["threshold"],
            settings["method"],
        )


def fit_knn(
    df: DataFrame,
    features: Sequence[str],
    id_col: str | Sequence[str],
    n_neighbors: int = 5,
    metric: str = "minkowski",
    p: float = 2,
    score_func: str = "max_distance",
    contamination: float = 0.1,
    method: str = "auto",
    on_null: str = "error",
    graph: nn.NeighbourGraph | None = None,
) -> KNearest:
    """``graph`` is a neighbour graph of the same rows, if there is one already."""
    if score_func not in fc.SCORE_FUNCS:
        raise ValueError(
            f"unknown score function {score_func!r}, choose from {', '.join(fc.SCORE_FUNCS)}"
        )
    if graph is None:
        rows = fit_rows(df, as_list(id_col), features, on_null)
        graph = nn.build_graph(rows, features, id_col, n_neighbors, metric, p, method)
    index = graph.index
    scores = graph.nearest(n_neighbors).select(
        "w", fc.neighbour_score(nn.distances(), n_neighbors, score_func).alias("score")
    )
    cut = contamination_threshold(scores, "score", contamination, index.n_rows, weight="w")
    return KNearest(index, n_neighbors, score_func, cut, method)
