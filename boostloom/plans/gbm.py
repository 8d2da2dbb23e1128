"""Gradient boosting for regression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boostloom.functions.losses import L2, Loss
from boostloom.operators.base import WeakLearner
from boostloom.operators.combined import WeightedMajority
from boostloom.plans.base import Booster, Score
from boostloom.sources.sample import TARGET, Sample


class GBM(Booster):
    """Adds regression hypotheses with the coefficient that fits the residuals best; ends when it is 0."""

    name = "Gradient Boosting Machine"

    def __init__(self, sample: Sample, loss: Loss | None = None):
        super().__init__(sample)
        self._loss, self._max_iter, self._tolerance = loss or L2(), 100, 0.0

    @staticmethod
    def init_with_loss(sample: Sample, loss: Loss) -> GBM:
        return GBM(sample, loss)

    def loss(self, loss: Loss):
        self._loss = loss
        return self

    def max_iter(self, n: int):
        self._max_iter = n
        return self

    def tolerance(self, value: float):
        """A coefficient of at most this size ends the run."""
        self._tolerance = value
        return self

    def preprocess(self, learner: WeakLearner) -> None:
        self.weights, self.hypotheses, self.rounds = [], [], 0
        self.train = learner.prepare(self.sample, keep_rows=False)
        self.m = self.train.m
        self.score = Score(self.train)

    def boost(self, learner: WeakLearner, t: int) -> bool:
        if t > self._max_iter:
            return True
        h = learner.produce(self.train, self.score.column)
        coefficient = self._loss.best_coefficient(self.train.df, F.col(TARGET) - self.score.column, h.predict(self.train.binned), F.col("n"))
        if abs(coefficient) <= self._tolerance:
            return True
        self.weights.append(coefficient)
        self.hypotheses.append(h)
        self.score.add(coefficient, h)
        self.rounds = t
        return False

    def current_hypothesis(self) -> WeightedMajority:
        """The coefficients as they were fitted, neither filtered nor scaled."""
        return WeightedMajority(self.weights, self.hypotheses)

    def confidence(self) -> Column:
        return self.score.column
