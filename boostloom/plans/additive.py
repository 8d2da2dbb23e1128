"""Boosters whose distribution is a function of one running sum."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from boostloom.operators.base import WeakLearner, edge_of, mass
from boostloom.plans.base import Booster, Builder
from boostloom.sources.sample import TARGET


class _Additive(Builder, Booster):
    def distribution(self) -> Column:
        """Each example's weight, up to a factor: exp(-y F), scaled against overflow."""
        shift = max(0.0, sum(abs(w) for w in self.weights) - 600.0)
        return F.exp(-F.col(TARGET) * self.score.column - F.lit(shift))

    def preprocess(self, learner: WeakLearner) -> None:
        super().preprocess(learner)
        self.tol = self._tolerance if self._tolerance is not None else self._default_tolerance()
        self.max_loop = self._limit(self._bound())

    def _default_tolerance(self) -> float:
        return 1.0 / (self.m + 1)

    def _bound(self) -> float:
        return math.floor(math.log(self.m) / self.tol**2)

    def _weight(self, edge: float) -> float:
        return 0.5 * math.log((1 + edge) / (1 - edge))

    def boost(self, learner: WeakLearner, t: int) -> bool:
        if t > self.max_loop:
            return True
        d = self.distribution()
        h = learner.produce(self.train, d)
        edge = edge_of(self.train, d, h)
        self.rounds = t
        if abs(edge) >= 1:  # one hypothesis settles it
            if edge < 0:
                raise ValueError("the learner returned a hypothesis that errs on every row")
            self.weights, self.hypotheses, self.edges = [1.0], [h], [edge]
            self.score.__init__(self.train)
            self.score.add(1.0, h)
            return True
        weight = self._weight(edge)
        self.weights.append(weight)
        self.hypotheses.append(h)
        self.edges = [*getattr(self, "edges", []), edge] if t > 1 else [edge]
        self.score.add(weight, h)
        return False


class AdaBoost(_Additive):
    name = "AdaBoost"


class AdaBoostV(_Additive):
    """Maximises the margin: the step aims at the least edge so far, less the tolerance."""

    name = "AdaBoostV"

    def preprocess(self, learner: WeakLearner) -> None:
        super().preprocess(learner)
        self.least_edge = 1.0

    def _default_tolerance(self) -> float:
        return 1.0 / self.m

    def _bound(self) -> float:
        return math.floor(2 * math.log(self.m) / self.tol**2)

    def _weight(self, edge: float) -> float:
        self.least_edge = min(self.least_edge, edge)
        rho = self.least_edge - self.tol
        return super()._weight(edge) - 0.5 * math.log((1 + rho) / (1 - rho))


class MadaBoost(_Additive):
    """AdaBoost whose weights never exceed their first value: min(1, exp(-y F))."""

    name = "MadaBoost"

    def distribution(self) -> Column:
        return F.exp(F.least(F.lit(0.0), -F.col(TARGET) * self.score.column))

    def _bound(self) -> float:
        return math.ceil((self.m - 1) / self.tol**2)


class SmoothBoost(Builder, Booster):
    """Bounded measures: N counts margins over theta, M = 1 up to 0 and then falls; a uniform vote.

    `gamma` in (0, 1/2) is the edge that the learner is trusted with; `tolerance` is the share of the
    measure under which a run ends.
    """

    name = "SmoothBoost"

    def gamma(self, value: float):
        if not 0 < value < 0.5:
            raise ValueError("gamma must lie between 0 and 1/2")
        self._gamma = value
        return self

    def preprocess(self, learner: WeakLearner) -> None:
        if not hasattr(self, "_gamma"):
            raise ValueError("gamma must be set")
        super().preprocess(learner)
        self.kappa = self._tolerance if self._tolerance is not None else 0.5
        self.theta = self._gamma / (2 + self._gamma)
        self.max_loop = self._limit(math.ceil(2 / (self.kappa * self._gamma**2 * math.sqrt(1 - self._gamma))))

    def measure(self) -> Column:
        n = 1 + F.col(TARGET) * self.score.column - len(self.hypotheses) * self.theta
        return F.when(n <= 0, 1.0).otherwise(F.pow(F.lit(1 - self._gamma), n / 2)) if self.hypotheses else F.lit(1.0)

    def boost(self, learner: WeakLearner, t: int) -> bool:
        if t > self.max_loop:
            return True
        m = self.measure()
        if t > 1 and self.train.df.agg(F.sum(mass(m))).first()[0] < self.m * self.kappa:
            return True
        h = learner.produce(self.train, m)
        self.hypotheses.append(h)
        self.weights = [1.0 / len(self.hypotheses)] * len(self.hypotheses)
        self.score.add(1.0, h)
        self.rounds = t
        return False

    def confidence(self) -> Column:
        return self.score.column / F.lit(float(max(1, len(self.hypotheses))))
