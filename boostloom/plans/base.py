"""The booster's loop, and the running sum of hypotheses over a table."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

from pyspark.sql import Column
from pyspark.sql import functions as F

from boostloom.operators.base import Prepared, WeakLearner
from boostloom.operators.combined import WeightedMajority, _sum
from boostloom.lineage import cut
from boostloom.sources.sample import Sample


class Score:
    """A column F = sum of w h over the rows of a prepared sample.

    Since the last cut it is an expression; every `every` additions the sum is written out, so that plans and
    generated code stay small.
    """

    def __init__(self, train: Prepared, every: int = 6):
        self.train, self.every = train, every
        self._base: Column = F.lit(0.0)
        self._since: list[tuple[float, object]] = []

    @property
    def column(self) -> Column:
        return _sum([self._base, *[F.lit(float(w)) * self._of(h) for w, h in self._since]])

    def _of(self, h) -> Column:
        return h.confidence(self.train.binned) if hasattr(h, "confidence") and not getattr(h, "regression", False) else h.predict(self.train.binned)

    def add(self, weight: float, h) -> None:
        self._since.append((weight, h))
        if len(self._since) >= self.every:
            old = self.train.df
            self.train.df = cut(old.withColumn("__score", self.column))
            old.unpersist()
            self._base, self._since = F.col("__score"), []


class Booster(ABC):
    """run(learner) = preprocess, boost(1), boost(2), ... until one returns True, postprocess."""

    name = ""

    def __init__(self, sample: Sample):
        self.sample = sample
        self.weights: list[float] = []
        self.hypotheses: list = []
        self.rounds = 0

    #: A booster whose state depends on single rows.
    keep_rows = False

    def run(self, learner: WeakLearner):
        self.preprocess(learner)
        t = 1
        while not self.boost(learner, t):
            t += 1
        return self.postprocess(learner)

    def preprocess(self, learner: WeakLearner) -> None:
        self.weights, self.hypotheses, self.rounds = [], [], 0
        self.sample.check_binary()
        self.train = learner.prepare(self.sample, self.keep_rows)
        self.m = self.train.m
        self.score = Score(self.train)

    @abstractmethod
    def boost(self, learner: WeakLearner, t: int) -> bool:
        """Round t; True if it was the last."""

    def postprocess(self, learner: WeakLearner):
        self.train.df.unpersist()
        return self.current_hypothesis()

    def current_hypothesis(self):
        return WeightedMajority.from_slices(self.weights, self.hypotheses)

    def confidence(self) -> Column:
        """The combination so far over the training rows; only its sign and scale matter to objectives."""
        total = sum(abs(w) for w in self.weights) or 1.0
        return self.score.column / F.lit(total)

    def info(self) -> dict[str, str]:
        return {"booster": self.name}


class Builder:
    """Setters shared by boosters; each returns the booster."""

    _tolerance: float | None = None
    _quit_at: int | None = None
    _nu: float = 1.0

    def tolerance(self, value: float):
        self._tolerance = value
        return self

    def force_quit_at(self, rounds: int):
        self._quit_at = rounds
        return self

    def nu(self, value: float):
        self._nu = float(value)
        return self

    def _check_nu(self) -> None:
        if not 1 <= self._nu <= self.m:
            raise ValueError(f"nu must lie between 1 and the number of rows, {self.m}")

    def _limit(self, bound: float) -> int:
        most = int(min(bound, 2**31)) if math.isfinite(bound) else 2**31
        return min(most, self._quit_at) if self._quit_at is not None else most
