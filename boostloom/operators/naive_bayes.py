"""Gaussian naive Bayes."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from boostloom.operators.base import Classifier, Prepared, WeakLearner, mass
from boostloom.sources.sample import TARGET, Sample

#: Variances are at least this.
LEAST_VARIANCE = 1e-9


class GaussianClassifier(Classifier):
    """Classes (label, prior, mean and variance by feature); its confidence is the label of the largest posterior.

    With `soft`, and labels -1 and 1, the confidence is the posterior of 1 less that of -1.
    """

    def __init__(self, classes: list[dict], soft: bool = False):
        self.classes, self.soft = sorted(classes, key=lambda c: c["label"]), soft

    def log_joint(self, label: float) -> Column:
        """ln of prior times density."""
        c = next(c for c in self.classes if c["label"] == label)
        terms = F.lit(math.log(c["prior"]))
        for f, (mean, variance) in c["features"].items():
            terms = terms - F.lit(0.5) * (math.log(2 * math.pi * variance) + (F.col(f"`{f}`") - mean) ** 2 / variance)
        return terms

    def posterior(self, label: float) -> Column:
        """The probability of a label."""
        logs = [self.log_joint(c["label"]) for c in self.classes]
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        total = sum((F.exp(x - top) for x in logs[1:]), F.exp(logs[0] - top))
        return F.exp(self.log_joint(label) - top) / total

    def confidence(self, binned: bool = False) -> Column:
        if self.soft and [c["label"] for c in self.classes] == [-1.0, 1.0]:  # each density once: the expression is copied into every filter and sum over it
            return F.lit(2.0) / (F.lit(1.0) + F.exp(self.log_joint(-1.0) - self.log_joint(1.0))) - F.lit(1.0)
        if self.soft:
            return self.posterior(1.0) - self.posterior(-1.0)
        best, value = F.lit(float(self.classes[0]["label"])), self.log_joint(self.classes[0]["label"])
        for c in self.classes[1:]:
            here = self.log_joint(c["label"])
            best, value = F.when(here >= value, float(c["label"])).otherwise(best), F.greatest(here, value)
        return best

    def to_json(self) -> str:
        return json.dumps({"kind": "gaussian_nb", "classes": self.classes, "soft": self.soft})


class GaussianNB(WeakLearner):
    name = "Gaussian Naive Bayes"

    def __init__(self, soft: bool = False):
        self._soft = soft

    def prepare(self, sample: Sample, keep_rows: bool = False) -> Prepared:
        out = super().prepare(sample, keep_rows)
        out.extra["features"] = sample.features
        return out

    def produce(self, train: Prepared, weight: Column) -> GaussianClassifier:
        """Two passes: weights and means by label, then variances about the means."""
        features, w = train.extra["features"], mass(weight)
        rows = train.df.withColumn("__w", w).filter("__w > 0")
        means = rows.groupBy(TARGET).agg(F.sum("__w").alias("__t"), *[(F.sum(F.col("__w") * F.col(f"`{f}`")) / F.sum("__w")).alias(f"m{i}") for i, f in enumerate(features)]).collect()
        total = sum(r["__t"] for r in means)
        label = F.col(TARGET)

        def mean_of(i: int) -> Column:
            out = F.lit(0.0)
            for r in means:
                out = F.when(label == r[TARGET], F.lit(r[f"m{i}"])).otherwise(out)
            return out

        spread = rows.groupBy(TARGET).agg(*[(F.sum(F.col("__w") * (F.col(f"`{f}`") - mean_of(i)) ** 2) / F.sum("__w")).alias(f"v{i}") for i, f in enumerate(features)])
        variances = {r[TARGET]: r for r in spread.collect()}
        return GaussianClassifier(
            [{"label": r[TARGET], "prior": r["__t"] / total, "features": {f: (r[f"m{i}"], max(variances[r[TARGET]][f"v{i}"], LEAST_VARIANCE)) for i, f in enumerate(features)}} for r in means],
            self._soft,
        )
