"""The core detector and the registry of all others: fit, scores, decisions, probabilities, evaluation.

Rows are (id, v) per encoder model, as a dictionary model -> DataFrame. The reference half is drawn once by the hash of the
id. Scores depend on the batch (see topology); evaluate scores both kinds as one batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typica.operators import density, kernel_margin, linear, neighbours
from typica.operators.topology import model_features
from typica.plans import metrics
from typica.storage import numbered, write_out


#: Of each method how it fits features and how it scores them.
METHODS: dict[str, tuple[Callable, Callable]] = {
    "gmm": (density.best_mixture, density.mixture_score),
    "kde": (density.fit_kernel, density.kernel_score),
    "ocsvm": (density.best_one_class, density.one_class_score),
    "ocsvm_rbf": (kernel_margin.best_kernel_margin, kernel_margin.kernel_margin_score),
}


class TypicalityDetector:
    """Topology features of one or more models under a density: method gmm, kde, ocsvm (linear) or ocsvm_rbf (Gaussian kernel).

    half: a condition on id that says which training rows are the reference; by default the hash of the id does.
    """

    def __init__(self, method: str = "gmm", *, nearest_k: int = 5, percent: float = 5.0, half: str | None = None):
        if method not in METHODS:
            raise ValueError(f"method {method!r}")
        self.method, self.k, self.percent, self.half = method, nearest_k, percent, half
        self.threshold: float | None = None

    def _half(self, rows: dict[str, DataFrame], part: int) -> dict[str, DataFrame]:
        first = F.pmod(F.xxhash64("id"), F.lit(2)) == 0 if self.half is None else F.expr(self.half)
        return {m: d.where(first if part == 0 else ~first) for m, d in rows.items()}

    def fit(self, train: dict[str, DataFrame]) -> TypicalityDetector:
        """The reference half is the bank; the other half's features train the density and set the threshold."""
        self.reference = self._half(train, 0)
        features = self._features(self._half(train, 1))
        self.model = METHODS[self.method][0](features)
        self.threshold = 0.0 if self.method.startswith("ocsvm") else metrics.percentile(write_out(self._score(features), "scores"), self.percent / 100)
        return self

    def _features(self, rows: dict[str, DataFrame]) -> DataFrame:
        """(id, v), written: all pairs are worked out once, and no task runs the workers of features and of scores at once."""
        return write_out(model_features(rows, self.reference, self.k).select("id", F.col("f").alias("v")), "features")

    def _score(self, features: DataFrame) -> DataFrame:
        """(id, score) of written features. Different ones are scored once each, so equal ones tie to the last digit."""
        each = numbered(features.select("v").distinct(), "key")
        found = METHODS[self.method][1](each.select(F.col("key").alias("id"), "v"), self.model)
        return features.join(each, "v").join(found.withColumnRenamed("id", "key"), "key").select("id", "score")

    def scores(self, rows: dict[str, DataFrame]) -> DataFrame:
        if self.threshold is None:
            raise RuntimeError("fit first")
        """Written, because thresholds, ranges and metrics read them again."""
        return write_out(self._score(self._features(rows)), "scores")

    def predict(self, rows: dict[str, DataFrame]) -> DataFrame:
        return metrics.decide(self.scores(rows), self.threshold)

    def predict_proba(self, rows: dict[str, DataFrame]) -> DataFrame:
        return metrics.probabilities(self.scores(rows))

    def evaluate(self, good: dict[str, DataFrame], bad: dict[str, DataFrame]) -> DataFrame:
        """One row of metrics over both kinds, scored as one batch; ids must differ between them."""
        both = {m: good[m].select("id", "v").unionByName(bad[m].select("id", "v")) for m in good}
        known = next(iter(good.values())).select("id").withColumn("is_id", F.lit(1))
        scores = self.scores(both).join(known, "id", "left").select("score", F.coalesce("is_id", F.lit(0)).alias("is_id"))
        return metrics.all_metrics(scores)


WITH_MARGIN = ("fdbd", "react", "nnguide", "adascale", "openmax", "vim")


def _margin(fit: DataFrame, background: DataFrame, options: dict) -> linear.Margin:
    return options.pop("margin", None) or linear.logistic_margin(fit, background)


#: name -> function of (rows, fit, background, options) giving (id, score).
DETECTORS: dict[str, Callable[..., DataFrame]] = {
    "knn": lambda r, f, b, **o: neighbours.mean_distance(r, f, **o),
    "cider": lambda r, f, b, **o: neighbours.kth_distance(r, f, **o),
    "mahalanobis": lambda r, f, b, **o: linear.mahalanobis(r, f),
    "rmd": lambda r, f, b, **o: linear.relative_mahalanobis(r, f, b, **o),
    "energy": lambda r, f, b, **o: linear.energy(r, **o),
    "fdbd": lambda r, f, b, **o: linear.boundary_distance(r, f, _margin(f, b, o), **o),
    "react": lambda r, f, b, **o: linear.rectified(r, f, _margin(f, b, o), **o),
    "nnguide": lambda r, f, b, **o: linear.guided_neighbours(r, f, _margin(f, b, o), **o),
    "adascale": lambda r, f, b, **o: linear.adaptive_scale(r, f, _margin(f, b, o), **o),
    "openmax": lambda r, f, b, **o: linear.open_max(r, f, b, _margin(f, b, o), **o),
    "vim": lambda r, f, b, **o: linear.virtual_logit(r, f, _margin(f, b, o), **o),
    "gmm": lambda r, f, b, k=8, kind="tied", raw=False, **o: density.mixture_score(r, density.fit_mixture(f, k, kind), raw=raw),
}


def register(name: str, score: Callable[..., DataFrame]) -> None:
    """Add a detector, a function of (rows, fit, background, options) giving (id, score), to those that Detector takes."""
    DETECTORS[name.strip().lower()] = score


class Detector:
    """Any of DETECTORS with the common interface; thresholds are the batch's median, or OpenMax' own."""

    def __init__(self, name: str, **options):
        self.name, self.options = name.strip().lower(), options
        if self.name not in DETECTORS:
            raise ValueError(f"detector {name!r}")
        self.fitted: tuple[DataFrame, DataFrame] | None = None

    def setup(self, fit: DataFrame, background: DataFrame) -> Detector:
        """A margin, where the detector takes one and none is given, is fitted here, once."""
        self.fitted = (fit, background)
        if self.name in WITH_MARGIN and "margin" not in self.options:
            self.options["margin"] = linear.logistic_margin(fit, background, weight=self.options.pop("margin_weight", 1.0))
        return self

    def set_hyperparam(self, **options) -> None:
        self.options |= options

    def get_hyperparam(self) -> dict:
        return dict(self.options)

    def postprocess(self, rows: DataFrame) -> DataFrame:
        if self.fitted is None:
            raise RuntimeError("setup first")
        return DETECTORS[self.name](rows, *self.fitted, **dict(self.options))

    def predict(self, rows: DataFrame) -> DataFrame:
        return metrics.decide(write_out(self.postprocess(rows), "scores"), 0.9 if self.name == "openmax" else None)  # all pairs once

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        scores = write_out(self.postprocess(rows), "scores")
        return scores.withColumn("proba", F.col("score")) if self.name == "openmax" else metrics.probabilities(scores)

    def evaluate(self, good: DataFrame, bad: DataFrame) -> DataFrame:
        both = good.select("id", "v", F.lit(1).alias("is_id")).unionByName(bad.select("id", "v", F.lit(0).alias("is_id")))
        scores = write_out(self.postprocess(both.select("id", "v")), "scores").join(both.select("id", "is_id"), "id")
        return metrics.all_metrics(scores.select("score", "is_id"))


def chosen(methods: str) -> list[str]:
    """Names of a comma-separated list, in any case; unknown ones raise."""
    names = [m.strip().lower() for m in methods.split(",") if m.strip()]
    unknown = [m for m in names if m not in DETECTORS and m not in {f"core_{x}" for x in METHODS}]
    if unknown:
        raise ValueError(f"methods {unknown}")
    return names
