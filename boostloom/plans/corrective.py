"""CERLPBoost and MLPBoost: Frank-Wolfe on the smoothed soft margin."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F

from boostloom.operators.base import WeakLearner
from boostloom.plans.frank_wolfe import FrankWolfe
from boostloom.plans.totally_corrective import _Corrective
from boostloom.sources.sample import ROW


class CERLPBoost(_Corrective):
    """Weights move by Frank-Wolfe steps; ends when the new edge exceeds the combination's by half the tolerance at most."""

    name = "Corrective ERLPBoost"
    _kind = "short_step"

    def fw_type(self, kind: str):
        self._kind = kind
        return self

    variant = fw_type
    frank_wolfe = fw_type

    def _default_tolerance(self) -> float:
        return 0.01

    def _bound(self) -> float:
        half, spread = self.tol / 2, math.log(max(self.m / self._nu, math.e))
        self.eta = spread / half
        return math.ceil(8 * spread / half**2)

    def preprocess(self, learner: WeakLearner) -> None:
        super().preprocess(learner)
        self.step = FrankWolfe(self.eta, self._kind)

    def _place(self, h) -> int:
        """The position of an equal hypothesis, or that of a new one."""
        for i, other in enumerate(self.hypotheses):
            if other == h:
                return i
        self._add(h)
        self.weights.append(0.0)
        return len(self.hypotheses) - 1

    def _gap(self, edge: float) -> float:
        return edge - float(self.programs.edges @ np.array(self.weights)) if self.weights else math.inf

    def boost(self, learner: WeakLearner, t: int) -> bool:
        if t > self.max_loop:
            return self._end(t)
        h, edge = self._produced(learner)
        gap = self._gap(edge)
        if gap <= self.tol / 2:
            return self._end(t)
        new = self._place(h)
        w = self._next(np.array(self.weights), new, t)
        self.weights = w.tolist()
        self.value = self.programs.smooth(w, self._nu, self.eta)
        self.weight = self.programs.weight()
        self.trace.append({"round": t, "edge": edge, "value": self.value, "gap": gap if math.isfinite(gap) else edge})
        self.rounds = t
        return False

    def _next(self, w: np.ndarray, new: int, t: int) -> np.ndarray:
        return self.step.next(w, new, t, self.programs, self._nu)


class MLPBoost(CERLPBoost):
    """Takes the better of the Frank-Wolfe step and the linear program's weights, by the smoothed objective."""

    name = "MLPBoost"
    _seed: int | None = None

    def perturbed(self, seed: int = 7777):
        """Add ln(ln(1 / r)) / eta to each row's margin in the linear program, r uniform by seed, round and row_id.

        Programs are solved over rows then, and the sample needs a row_id, so that noise doesn't depend on the partitions.
        """
        self._seed = seed
        self.keep_rows = True
        return self.over_rows()

    def preprocess(self, learner: WeakLearner) -> None:
        super().preprocess(learner)
        self.least_edge = 1.0
        if self._seed is not None and ROW not in self.train.df.columns:
            raise ValueError(f"a perturbed program needs rows with a {ROW}")

    def _gap(self, edge: float) -> float:
        self.least_edge = min(self.least_edge, edge)
        return self.least_edge - self.value if self.weights else math.inf

    def _next(self, w: np.ndarray, new: int, t: int) -> np.ndarray:
        primary = super()._next(w, new, t)
        if self._seed is not None:
            self.programs.inner.noise = double_log_noise(F.col(ROW), self._seed, t) / self.eta
        secondary = self.programs.soft_margin(self._nu, self.tol / 4)[1]
        reached = [self.programs.smooth(x, self._nu, self.eta) for x in (secondary, primary)]
        return secondary if reached[0] > reached[1] else primary


def double_log_noise(row: Column, seed: int, t: int) -> Column:
    """ln(ln(1 / r)) with r in (0, 1) from a hash of the row's number, the seed and the round: minus a Gumbel variable."""
    bits = F.shiftrightunsigned(F.xxhash64(row, F.lit(seed), F.lit(t)), 12).cast("double")
    return F.log(-F.log((bits + 0.5) / 2.0**52))
