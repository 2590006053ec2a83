"""Fit several detectors on one scaled table, then score and flag rows with all of them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, replace
from datetime import datetime, timezone

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.operators import autoencoder, forest, gaussian, kmeans, knn, lof, pca, svm
from strayrow.operators import neighbours as nn
from strayrow.operators.base import (
    Fitted,
    NotTrainedError,
    RowModel,
    split_missing,
    with_missing,
)
from strayrow.operators.frame import as_list, feature_columns, fit_rows
from strayrow.operators.scale import SCALERS, Scaler, scaler_from_stats
from strayrow.operators.stats import FeatureStats, collect_stats
from strayrow.operators.threshold import METHODS, check_contamination, quantiles
from strayrow.plans.detectors import DETECTORS, detector
from strayrow.session import spread
from strayrow.sources import state

OUTPUTS = ("wide", "long")
KNN = knn.KNearest.key
LOF = lof.LocalOutlierFactor.key
# Detectors that follow from the statistics and need the rows for their cut only.
FROM_STATISTICS = {pca.PcaMahalanobis.key, gaussian.Gaussian.key}


@dataclass(frozen=True)
class Progress:
    """A detector that has been fitted, the how many-th of how many, and how long it took."""

    detector: str
    done: int
    total: int
    seconds: float


class Pipeline:
    """Detectors to be fitted together, in the order they were added."""

    def __init__(self, scaler: str = "minmax", threshold_method: str = "exact"):
        if scaler not in SCALERS:
            raise ValueError(f"unknown scaler {scaler!r}, choose from {', '.join(SCALERS)}")
        if threshold_method not in METHODS:
            raise ValueError(f"threshold_method must be one of {', '.join(METHODS)}")
        self.scaler = scaler
        self.threshold_method = threshold_method
        self.specs: dict[str, dict] = {}
        self.fitted: FittedPipeline | None = None

    def add(self, key: str, **parameters) -> Pipeline:
        self.specs[key] = detector(key).settings(parameters)
        return self

    def fit(
        self,
        df: DataFrame,
        features: Sequence[str],
        id_col: str | Sequence[str],
        label_col: str | None = None,
        on_null: str = "error",
        parallel: int = 1,
        progress: Callable[[Progress], None] | None = None,
    ) -> FittedPipeline:
        """Every fit starts anew: statistics, scaler and detectors come from ``df`` alone.

        One pass takes the statistics of the raw features. The scaler, the principal
        axes and the densities follow from them. Detectors that look at single rows
        share one scoring pass for their cuts.

        Up to ``parallel`` detectors are fitted at once over the same persisted table.
        Each fit is a job group, in a scheduler pool of its own name, which shares the
        executors fairly if the session runs with ``spark.scheduler.mode=FAIR``. After
        each fit ``progress`` is called, in the caller's thread, once for every detector.
        The result does not depend on ``parallel``. If a fit fails, jobs of the others
        are cancelled and its error is raised.
        """
        if parallel < 1:
            raise ValueError("parallel must be at least 1")
        if not self.specs:
            raise ValueError("add a detector before fitting")
        ids, features = as_list(id_col), list(features)
        labels = [label_col] if label_col and label_col not in ids else []
        rows = fit_rows(df, [*ids, *labels], features, on_null)
        raw = collect_stats(rows, features, with_cov="pca_mahalanobis" in self.specs)
        scaler = scaler_from_stats(raw, features, self.scaler)
        stats = raw.affine(scaler.shift, scaler.scale)
        scaled = scaler.transform(rows)
        if set(self.specs) - FROM_STATISTICS:
            scaled = spread(scaled, stats.n).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            graph = self._shared_graph(scaled, features, ids)
            models = self._shapes(scaled, features, ids, stats, graph, parallel, progress)
            if graph is not None:
                # The table of the one has all columns the other needs.
                models[KNN] = replace(models[KNN], index=models[LOF].index)
            models = self._set_cuts(models, scaled, features, label_col, stats.n)
        finally:
            scaled.unpersist()
        self.fitted = FittedPipeline(scaler, tuple(ids), models)
        return self.fitted

    def _shared_graph(self, scaled: DataFrame, features, ids) -> nn.NeighbourGraph | None:
        """One neighbour graph for both detectors that need one, if their metric is the same."""
        if KNN not in self.specs or LOF not in self.specs:
            return None
        one, other = self.specs[KNN], self.specs[LOF]
        order = nn.metric_order(one["metric"], one["p"])
        if order != nn.metric_order(other["metric"], other["p"]) or one["method"] != other["method"]:
            return None
        k = max(one["n_neighbors"], other["n_neighbors"])
        return nn.build_graph(scaled, features, ids, k, one["metric"], one["p"], one["method"])

    def flag(self, df: DataFrame, output: str = "wide", on_null: str = "error") -> DataFrame:
        if self.fitted is None:
            raise NotTrainedError("the pipeline has not been fitted")
        return self.fitted.flag(df, output, on_null)

    def _shapes(
        self, scaled: DataFrame, features, ids, stats: FeatureStats, graph, parallel: int, progress
    ) -> dict[str, Fitted]:
        """All detectors, those that score single rows still without their cut."""
        spark = scaled.sparkSession
        context = spark.sparkContext
        run = uuid.uuid4().hex[:8]
        done: dict[str, Fitted] = {}

        def shape(key: str) -> tuple[Fitted, float]:
            start = time.monotonic()
            model = self._shape(key, self.specs[key], scaled, features, ids, stats, graph)
            return model, time.monotonic() - start

        def report(key: str, seconds: float) -> None:
            if progress is not None:
                progress(Progress(key, len(done), len(self.specs), seconds))

        if parallel == 1:
            for key in self.specs:
                done[key], seconds = shape(key)
                report(key, seconds)
            return done

        def fit(key: str) -> tuple[Fitted, float]:
            context.setLocalProperty("spark.scheduler.pool", key)
            context.setJobGroup(f"fit-{run}-{key}", f"fit {key}", interruptOnCancel=True)
            return shape(key)

        with ThreadPoolExecutor(parallel) as pool:
            running = {pool.submit(inheritable_thread_target(spark)(fit), key): key for key in self.specs}
            try:
                for future in as_completed(running):
                    key = running[future]
                    done[key], seconds = future.result()
                    report(key, seconds)
            except BaseException:
                for future, key in running.items():
                    future.cancel()
                    context.cancelJobGroup(f"fit-{run}-{key}")
                raise
        return {key: done[key] for key in self.specs}

    def _shape(
        self, key, spec, scaled: DataFrame, features, ids, stats: FeatureStats, graph
    ) -> Fitted:
        """A fitted detector; those that score single rows still lack their cut."""
        if "contamination" in spec:
            check_contamination(spec["contamination"])
        if key == "pca_mahalanobis":
            return pca.unfitted_threshold(stats, features, spec["n_components"])
        if key == "gaussian_distribution":
            return gaussian.from_stats(stats, features)
        rest = {k: v for k, v in spec.items() if k != "contamination"}
        if key == "kmeans":
            return kmeans.fit_centroids(scaled, features, **rest)
        if key == "autoencoder":
            return autoencoder.fit_network(scaled, features, ids, **rest)
        if key == "isolation_forest":
            return forest.fit_trees(scaled, features, ids, stats.n, **rest)
        if key == "one_class_svm":
            return svm.fit_plane(scaled, features, stats, spec["contamination"], **rest)
        fit = knn.fit_knn if key == KNN else lof.fit_lof
        return fit(scaled, features, ids, **spec, graph=graph)

    def _set_cuts(self, models, scaled: DataFrame, features, label_col, n: int):
        by_row = {k: m for k, m in models.items() if isinstance(m, RowModel)}
        if not by_row:
            return models
        cells = [F.col(f"`{f}`") for f in features]
        labels = [F.col(f"`{label_col}`")] if label_col else []
        scores = scaled.select(
            *labels, *[m.score_column(cells).alias(k) for k, m in by_row.items()]
        ).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            shares = {
                k: 1.0 - self.specs[k]["contamination"]
                for k in by_row
                if "contamination" in self.specs[k]
            }
            cuts = quantiles(scores, shares, n, self.threshold_method) if shares else {}
            done = {k: replace(models[k], threshold=cut) for k, cut in cuts.items()}
            key = gaussian.Gaussian.key
            if key in by_row:
                candidates = self.specs[key]["epsilon_candidates"]
                epsilon, _ = gaussian.search_epsilon(scores, key, label_col, candidates)
                done[key] = gaussian.with_epsilon(models[key], epsilon)
        finally:
            scores.unpersist()
        return {k: done.get(k, m) for k, m in models.items()}


@dataclass(frozen=True)
class FittedPipeline:
    scaler: Scaler
    ids: tuple[str, ...]
    models: dict[str, Fitted]

    @property
    def features(self) -> tuple[str, ...]:
        return self.scaler.features

    def score(self, df: DataFrame, on_null: str = "error") -> DataFrame:
        """Id columns, and ``<detector>_score`` and ``<detector>`` (the flag) per detector.

        Rows pass through once: what single rows tell is one projection, and detectors
        that compare with the same training points share one neighbour join.
        """
        ids = [F.col(f"`{c}`") for c in self.ids]
        cells = df.select(*ids, *feature_columns(df, self.features, on_null))
        scaled = self.scaler.transform(cells)
        columns = [F.col(f"`{f}`") for f in self.features]
        by_row = {k: m for k, m in self.models.items() if isinstance(m, RowModel)}
        by_join = [(k, m) for k, m in self.models.items() if k not in by_row]
        missing = None
        if by_join:
            scaled, missing = split_missing(scaled, self.features, on_null)
        scores = [m.score_column(columns).alias(f"{k}_score") for k, m in by_row.items()]
        done = [f"{k}_score" for k in by_row]
        out = scaled.select(*ids, *columns, *scores)
        while by_join:
            first = by_join[0][1]
            group = [
                (k, m) for k, m in by_join if m.index is first.index and m.method == first.method
            ]
            by_join = [pair for pair in by_join if pair not in group]
            ahead = [*done, *(self.features if by_join else ())]
            most = max(m.n_neighbors for _, m in group)

            # The factor gathers the edges of a row again, so it comes last.
            def finish(found: DataFrame, keys: Sequence[str], group=group) -> DataFrame:
                for key, model in sorted(group, key=lambda pair: pair[0] == LOF):
                    found = model.add_score(found, keys, f"{key}_score")
                return found.drop("neighbours")

            out = nn.neighbours(out, self.ids, first.index, most, first.method, carry=ahead, finish=finish)
            done += [f"{k}_score" for k, _ in group]
        out = with_missing(out.select(*ids, *done), missing)
        return out.select(
            *ids,
            *[F.col(f"{k}_score") for k in self.models],
            *[m.flag_column(F.col(f"{k}_score")).alias(k) for k, m in self.models.items()],
        )

    def flag(self, df: DataFrame, output: str = "wide", on_null: str = "error") -> DataFrame:
        """``wide``: one boolean per detector; ``long``: ``detector``, ``score`` and ``flag`` rows."""
        if output not in OUTPUTS:
            raise ValueError(f"output must be one of {', '.join(OUTPUTS)}")
        scored = self.score(df, on_null)
        ids = [F.col(f"`{c}`") for c in self.ids]
        if output == "wide":
            return scored.select(*ids, *[F.col(k) for k in self.models])
        items = [
            F.struct(
                F.lit(k).alias("detector"),
                F.col(f"{k}_score").alias("score"),
                F.col(k).alias("flag"),
            )
            for k in self.models
        ]
        return scored.select(*ids, F.explode(F.array(*items)).alias("_r")).select(*ids, "_r.*")

    def save(
        self,
        spark: SparkSession,
        path: str,
        model_id: str,
        created: datetime | None = None,
        updated: datetime | None = None,
    ) -> None:
        """Store the scaler and all detectors under a new folder; dates are now if not given."""
        updated = updated or datetime.now(timezone.utc)
        created = created or updated
        arrays = {"shift": self.scaler.shift, "scale": self.scaler.scale}
        state.write_arrays(spark, arrays, f"{path}/scaler")
        shared = self._share_points()
        records = {
            key: state.write_parts(spark, model, f"{path}/{key}", with_tables=not (shared and key == KNN))
            for key, model in self.models.items()
        }
        settings = {
            "scaler": self.scaler.kind,
            "ids": list(self.ids),
            "detectors": records,
            "shared_points": shared,
        }
        state.write_metadata(
            spark, path, model_id, created, updated, self.models, self.features, settings
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedPipeline:
        meta = state.read_metadata(spark, path)
        settings = meta["settings"]
        arrays = state.read_arrays(spark, f"{path}/scaler")
        scaler = Scaler(
            settings["scaler"],
            tuple(meta["columns"]),
            np.asarray(arrays["shift"]),
            np.asarray(arrays["scale"]),
        )
        shared = settings["shared_points"]
        models = {
            key: state.read_parts(
                spark,
                DETECTORS[key].kind,
                settings["detectors"][key],
                f"{path}/{key}",
                tables_path=f"{path}/{LOF}" if shared and key == KNN else None,
            )
            for key in meta["models"]
        }
        if shared:
            models[KNN] = replace(models[KNN], index=models[LOF].index)
        return cls(scaler, tuple(settings["ids"]), models)

    def _share_points(self) -> bool:
        return (
            KNN in self.models
            and LOF in self.models
            and self.models[KNN].index is self.models[LOF].index
        )


def save_detector(spark: SparkSession, model: Fitted, path: str, model_id: str) -> None:
    """Store one detector on its own."""
    created = datetime.now(timezone.utc)
    record = state.write_parts(spark, model, f"{path}/{model.key}")
    state.write_metadata(
        spark, path, model_id, created, created, [model.key], model.features, record
    )


def load_detector(spark: SparkSession, path: str) -> Fitted:
    meta = state.read_metadata(spark, path)
    (key,) = meta["models"]
    return state.read_parts(spark, DETECTORS[key].kind, meta["settings"], f"{path}/{key}")
