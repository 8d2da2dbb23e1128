"""Leveraging for regression: residuals become weights and signs for a weak learner, and the next coefficient.

A round is one aggregate over the running residuals (their mean and sums of squares, or of potentials), the learner's
own, and one for the coefficient; residuals are an expression over the running sum of hypotheses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from boostloom.operators.base import Classifier, WeakLearner
from boostloom.operators.combined import WeightedMajority
from boostloom.plans.base import Booster, Score
from boostloom.sources.sample import TARGET, Sample


class _Leveraging(Booster):
    """Fits regressors (given the present prediction) or classifiers (given weights and signs) to residuals."""

    def __init__(self, sample: Sample):
        super().__init__(sample)
        self._max_iter, self._tolerance = 100, 0.01

    def max_iter(self, n: int):
        self._max_iter = n
        return self

    def tolerance(self, value: float):
        self._tolerance = float(value)
        return self

    def preprocess(self, learner: WeakLearner) -> None:
        self.weights, self.hypotheses, self.rounds, self.trace = [], [], 0, []
        self.constant = 0.0
        self.train = learner.prepare(self.sample, keep_rows=False)
        self.m = self.train.m
        self.score = Score(self.train)

    @property
    def residual(self) -> Column:
        return F.col(TARGET) - self.score.column

    def _value(self, h) -> Column:
        return h.confidence(self.train.binned) if isinstance(h, Classifier) and not getattr(h, "regression", False) else h.predict(self.train.binned)

    def _keep(self, t: int, weight: float, h) -> bool:
        self.weights.append(weight)
        self.hypotheses.append(h)
        self.score.add(weight, h)
        self.rounds = t
        return False

    def current_hypothesis(self) -> Shifted:
        return Shifted(self.constant, self.weights, self.hypotheses)

    def confidence(self) -> Column:
        return F.lit(self.constant) + self.score.column


class Shifted(WeightedMajority):
    """A weighted sum and a constant."""

    def __init__(self, constant: float, weights: list[float], hypotheses: list):
        super().__init__(weights, hypotheses)
        self.constant = constant

    def predict(self, binned: bool = False) -> Column:
        parts = [F.lit(float(w)) * (h.confidence(binned) if isinstance(h, Classifier) and not getattr(h, "regression", False) else h.predict(binned)) for w, h in zip(self.weights, self.hypotheses, strict=True)]
        return sum(parts, F.lit(float(self.constant)))


class SquareLevR(_Leveraging):
    """The potential is the variance of the residuals; a coefficient is the slope of the residuals on the hypothesis.

    The learner sees the residuals (a constant part of its hypothesis goes into the constant term).  Ends when the variance is under the
    tolerance, or a hypothesis is constant or doesn't correlate.  The constant term is the last mean residual.
    """

    name = "SquareLev.R"

    def boost(self, learner: WeakLearner, t: int) -> bool:
        n = F.col("n")
        mean, square = self.train.df.agg(F.sum(n * self.residual) / F.sum(n), F.sum(n * self.residual**2) / F.sum(n)).first()
        variance = square - mean**2
        self.constant = float(mean)
        if t > self._max_iter or variance < self._tolerance:
            return True
        h = learner.produce(self.train, self.score.column)
        r, f = self.residual, self._value(h)
        sums = self.train.df.agg(*[(F.sum(n * x) / F.sum(n)).alias(k) for k, x in (("f", f), ("ff", f * f), ("rf", r * f))]).first()
        spread = sums["ff"] - sums["f"] ** 2
        together = sums["rf"] - mean * sums["f"]
        if spread <= 1e-12 * max(1.0, sums["ff"]) or together == 0.0:
            return True
        self.trace.append({"round": t, "potential": float(variance), "correlation": float(together / math.sqrt(spread * variance)), "weight": float(together / spread)})
        self._keep(t, float(together / spread), h)
        self.constant = float(mean - together / spread * sums["f"])
        return False


class ExpLev(_Leveraging):
    """The potential is the sum of exp(s r) + exp(-s r) - 2; weights are its derivative's size, labels its sign.

    The learner is a classifier on the weighted signs of the residuals; a hypothesis f in [-1, 1] with edge e gets
    the coefficient ln((1 + e) / (1 - e)) / (2 s), e at most `most_edge`, which lowers the potential for every sample.  Ends when no residual
    is over the tolerance eta in size (s is ln(m) / eta), or an edge isn't positive.
    """

    name = "ExpLev"

    def __init__(self, sample: Sample):
        super().__init__(sample)
        self._s: float | None = None
        self._most_edge = 0.99

    def softness(self, s: float):
        """The factor s of residuals in the potential."""
        self._s = float(s)
        return self

    def most_edge(self, value: float):
        self._most_edge = float(value)
        return self

    def preprocess(self, learner: WeakLearner) -> None:
        super().preprocess(learner)
        self.s = self._s if self._s is not None else math.log(max(self.m, 2)) / self._tolerance

    def boost(self, learner: WeakLearner, t: int) -> bool:
        r, s, n = self.residual, F.lit(self.s), F.col("n")
        largest = float(self.train.df.agg(F.max(F.abs(r))).first()[0] or 0.0)
        if t > self._max_iter or largest <= self._tolerance:
            return True
        # the size of the derivative, s (exp(s |r|) - exp(-s |r|)), divided by its largest exponential
        size = F.exp(s * (F.abs(r) - largest)) - F.exp(-s * (F.abs(r) + largest))
        rows, train = self.train.df, self.train
        signs = rows.withColumn("__w", size).withColumn("__r", r).withColumn("__y", F.col(TARGET)).withColumn(TARGET, F.when(r >= 0, 1.0).otherwise(-1.0))
        train.df = signs
        h = learner.produce(train, F.col("__w"))
        train.df = rows
        w = n * F.col("__w")
        together, total, potential = signs.agg(F.sum(w * F.col(TARGET) * self._value(h)), F.sum(w), F.log(F.sum(n * (F.exp(s * (F.col("__r") - largest)) + F.exp(s * (-F.col("__r") - largest)) - 2 * F.exp(-s * largest))))).first()
        edge = min(float(together / total), self._most_edge) if total else 0.0
        if edge <= 0:
            return True
        weight = math.log((1 + edge) / (1 - edge)) / (2 * self.s)
        self.trace.append({"round": t, "potential": float(potential) + self.s * largest, "correlation": edge, "weight": weight})
        return self._keep(t, weight, h)
