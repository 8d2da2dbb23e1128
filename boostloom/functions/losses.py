"""Losses for gradient boosting, and objectives that a run is logged by."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostloom.functions import stats
from boostloom.sources.sample import TARGET, Sample


class Loss(ABC):
    """A regression loss; gradients and Hessians are by the prediction."""

    name: str

    @abstractmethod
    def at_point(self, p: Column, y: Column) -> Column: ...

    @abstractmethod
    def gradient(self, p: Column, y: Column) -> Column: ...

    @abstractmethod
    def hessian(self, p: Column, y: Column) -> Column: ...

    @abstractmethod
    def best_coefficient(self, rows: DataFrame, residual: Column, h: Column, number: Column | None = None) -> float:
        """The step along h that fits the residuals best; a row stands for `number` examples (1 by default)."""

    def mean(self, p: Column, y: Column | None = None) -> Column:
        """Aggregate: the mean loss."""
        return F.avg(self.at_point(p, F.col(TARGET) if y is None else y))


class L1(Loss):
    name = "L1"

    def at_point(self, p: Column, y: Column) -> Column:
        return F.abs(p - y)

    def gradient(self, p: Column, y: Column) -> Column:
        return F.signum(p - y)

    def hessian(self, p: Column, y: Column) -> Column:
        return F.lit(0.0)

    def best_coefficient(self, rows: DataFrame, residual: Column, h: Column, number: Column | None = None) -> float:
        """The weighted median of residual / h, over rows where h isn't 0."""
        return stats.weighted_median(rows, F.when(h != 0, residual / F.when(h != 0, h)), F.abs(h) * (1 if number is None else number))


class L2(Loss):
    name = "L2"

    def at_point(self, p: Column, y: Column) -> Column:
        return (p - y) ** 2

    def gradient(self, p: Column, y: Column) -> Column:
        return p - y

    def hessian(self, p: Column, y: Column) -> Column:
        return F.lit(1.0)

    def best_coefficient(self, rows: DataFrame, residual: Column, h: Column, number: Column | None = None) -> float:
        n = F.lit(1) if number is None else number
        top, bottom = rows.agg(F.sum(n * residual * h), F.sum(n * h * h)).first()
        return float(top / bottom) if bottom else 0.0


class Objective(ABC):
    """A number for a combined hypothesis on a sample."""

    name: str

    @abstractmethod
    def value(self, rows: DataFrame, confidence: Column, number: Column | None = None) -> float:
        """`number`: how many examples a row stands for (1 by default)."""

    def eval(self, sample: Sample, hypothesis) -> float:
        return self.value(sample.df, hypothesis.confidence())


class SoftMargin(Objective):
    """The mean of the nu least margins."""

    name = "Soft-margin objective"

    def __init__(self, nu: float):
        self.nu = float(nu)

    def value(self, rows: DataFrame, confidence: Column, number: Column | None = None) -> float:
        return stats.lower_tail_mean(rows, stats.margin(confidence), F.lit(1) if number is None else number, self.nu)


class HardMargin(Objective):
    """The least margin."""

    name = "Hard-margin objective"

    def value(self, rows: DataFrame, confidence: Column, number: Column | None = None) -> float:
        return float(rows.agg(F.min(stats.margin(confidence))).first()[0])


class ExponentialLoss(Objective):
    """The mean of exp(-y f), where f is the predicted label, or the confidence with on="confidence"."""

    name = "Exponential loss"

    def __init__(self, on: str = "label"):
        self.on = on

    def value(self, rows: DataFrame, confidence: Column, number: Column | None = None) -> float:
        f = confidence if self.on == "confidence" else F.when(confidence >= 0, 1.0).otherwise(-1.0)
        n = F.lit(1) if number is None else number
        total, count = rows.agg(F.sum(n * F.exp(-stats.margin(f))), F.sum(n)).first()
        return float(total / count)
