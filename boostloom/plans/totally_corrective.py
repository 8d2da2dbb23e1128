"""Boosters that solve a program over all hypotheses in each round: LPBoost, SoftBoost, TotalBoost, ERLPBoost."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from boostloom.operators.base import WeakLearner, edge_of
from boostloom.plans.base import Booster, Builder
from boostloom.plans.programs import Switch


class _Corrective(Builder, Booster):
    _rows = False

    def over_rows(self, wanted: bool = True):
        """Solve programs over rows from the start, not only when margins take too many values for groups on the driver."""
        self._rows = wanted
        return self

    def preprocess(self, learner: WeakLearner) -> None:
        super().preprocess(learner)
        self._check_nu()
        self.tol = self._tolerance if self._tolerance is not None else self._default_tolerance()
        self.programs = Switch(self.train, self._rows)
        self.weight: Column = F.lit(1.0 / self.m)
        self.terminated_at, self.trace = None, []
        self.max_loop = self._limit(self._bound())

    @property
    def groups(self):
        """Groups of equal margins and, as d, a member's share: while programs are solved over groups."""
        return self.programs.inner.groups

    @property
    def d(self) -> np.ndarray:
        return self.programs.inner.d

    def _add(self, h) -> None:
        self.programs.add(h)
        self.hypotheses.append(h)

    def _default_tolerance(self) -> float:
        return 1.0 / self.m

    def _bound(self) -> float:
        return math.inf

    def terminated(self) -> int | None:
        """The round after which the run ended."""
        return self.terminated_at

    def _produced(self, learner: WeakLearner) -> tuple[object, float]:
        h = learner.produce(self.train, self.weight)
        return h, edge_of(self.train, self.weight, h)

    def _end(self, t: int) -> bool:
        self.terminated_at = t
        return True

    def confidence(self) -> Column:
        return self.current_hypothesis().confidence(self.train.binned)


class LPBoost(_Corrective):
    """Soft-margin linear program; ends when no hypothesis has an edge over its value, less the tolerance."""

    name = "LPBoost"

    def preprocess(self, learner: WeakLearner) -> None:
        super().preprocess(learner)
        self.least_edge, self.value = 1.0, -1.0

    def boost(self, learner: WeakLearner, t: int) -> bool:
        if t > self.max_loop:
            return self._end(t)
        h, edge = self._produced(learner)
        self.least_edge = min(self.least_edge, edge)
        if t > 1 and self.value >= self.least_edge - self.tol:
            return self._end(t)
        self._add(h)
        self.value, w = self.programs.soft_margin(self._nu, self.tol / 4)
        self.weights = w.tolist()
        self.weight = self.programs.weight()
        self.trace.append({"round": t, "edge": edge, "value": self.value, "gap": self.least_edge - self.value})
        self.rounds = t
        return False


class SoftBoost(_Corrective):
    """Least divergence with all edges at most the least edge so far, less the tolerance; ends when there is none."""

    name = "SoftBoost"

    def preprocess(self, learner: WeakLearner) -> None:
        super().preprocess(learner)
        self.least_edge = 1.0

    def _bound(self) -> float:
        return math.ceil(max(1.0, 2 * math.log(max(self.m / self._nu, math.e)) / self.tol**2))

    def boost(self, learner: WeakLearner, t: int) -> bool:
        if t > self.max_loop:
            return self._end(t)
        h, edge = self._produced(learner)
        self.least_edge = min(self.least_edge, edge)
        self._add(h)
        self.rounds = t
        found = self.programs.least_divergence(self._nu, self.least_edge - self.tol)
        self.trace.append({"round": t, "edge": edge, "value": self.least_edge - self.tol, "gap": float(self.programs.edges.max()) if found else 0.0})
        self.weights = []
        if not found:
            return self._end(t)
        self.weight = self.programs.weight()
        return False

    def current_hypothesis(self):
        if len(self.weights) != len(self.hypotheses):
            self.weights = self.programs.soft_margin(self._nu, self.tol / 4)[1].tolist()
        return super().current_hypothesis()


class TotalBoost(SoftBoost):
    """SoftBoost without a cap on weights."""

    name = "TotalBoost"

    def nu(self, value: float):
        raise AttributeError("TotalBoost has no capping parameter")


class ERLPBoost(_Corrective):
    """Largest edge plus divergence / eta; ends when the value is within half the tolerance of the bound."""

    name = "ERLPBoost"
    _least = 1

    def at_least(self, rounds: int):
        """Go on for so many rounds, even where the value is close enough to the bound before."""
        self._least = rounds
        return self

    def _default_tolerance(self) -> float:
        return 0.01

    def _bound(self) -> float:
        half = self.tol / 2
        spread = math.log(max(self.m / self._nu, 1.0))
        self.eta = max(0.5, spread / half)
        return math.ceil(max(4 / half, 8 * spread / half**2))

    def preprocess(self, learner: WeakLearner) -> None:
        super().preprocess(learner)
        self.bound, self.value = 1.0, -1.0

    def boost(self, learner: WeakLearner, t: int) -> bool:
        if t > self.max_loop:
            return self._end(t)
        h, edge = self._produced(learner)
        self.bound = min(self.bound, edge + self.programs.divergence / self.eta)
        if t > max(self._least, 1) and self.bound - self.value <= self.tol / 2:
            return self._end(t)
        self._add(h)
        self.value, w = self.programs.entropy(self._nu, self.eta, np.array(self.weights) if self.weights else None)
        self.weights = w.tolist()
        self.weight = self.programs.weight()
        self.trace.append({"round": t, "edge": edge, "value": self.value, "gap": self.bound - self.value})
        self.rounds = t
        return False
