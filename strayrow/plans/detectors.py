"""The eight detectors by key: their parameters and how they are fitted in a pipeline."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from strayrow.operators import autoencoder, forest, gaussian, kmeans, knn, lof, pca, svm
from strayrow.operators.base import Fitted

# Arguments every fit function takes from its caller, not from the detector's settings.
GIVEN = {"df", "features", "id_col", "label_col", "on_null", "graph"}


@dataclass(frozen=True)
class Detector:
    key: str
    kind: type[Fitted]
    fit: Callable[..., Fitted]

    @property
    def parameters(self) -> dict[str, inspect.Parameter]:
        found = inspect.signature(self.fit).parameters
        return {name: p for name, p in found.items() if name not in GIVEN}

    def settings(self, given: dict) -> dict:
        """Defaults overridden by what was given; an unknown name is an error."""
        known = self.parameters
        unknown = sorted(set(given) - set(known))
        if unknown:
            raise TypeError(f"{self.key} has no parameters {', '.join(unknown)}")
        return {name: given.get(name, p.default) for name, p in known.items()}


DETECTORS = {
    d.key: d
    for d in (
        Detector("pca_mahalanobis", pca.PcaMahalanobis, pca.fit_pca_mahalanobis),
        Detector("autoencoder", autoencoder.Autoencoder, autoencoder.fit_autoencoder),
        Detector("kmeans", kmeans.KMeansModel, kmeans.fit_kmeans),
        Detector("one_class_svm", svm.OneClassSvm, svm.fit_one_class_svm),
        Detector("gaussian_distribution", gaussian.Gaussian, gaussian.fit_gaussian),
        Detector("isolation_forest", forest.IsolationForest, forest.fit_isolation_forest),
        Detector("knearest_neighbors", knn.KNearest, knn.fit_knn),
        Detector("local_outlier_factor", lof.LocalOutlierFactor, lof.fit_lof),
    )
}


def detector(key: str) -> Detector:
    try:
        return DETECTORS[key]
    except KeyError:
        raise KeyError(f"no detector {key!r}, choose from {', '.join(DETECTORS)}") from None
