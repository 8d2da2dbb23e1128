"""What hypotheses and weak learners have in common."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostloom.sources.sample import TARGET, Sample


class Classifier(ABC):
    """A hypothesis whose confidence, in [-1, 1], is a Column over a sample's rows."""

    #: Edge on the rows and weights that it was fitted to, if the learner knows it.
    edge: float | None = None

    @abstractmethod
    def confidence(self, binned: bool = False) -> Column:
        """`binned`: over the bin columns of a prepared sample (the same value) instead of raw features."""

    def predict(self, binned: bool = False) -> Column:
        return F.when(self.confidence(binned) >= 0, F.lit(1)).otherwise(F.lit(-1))

    def confidence_all(self, sample: Sample, name: str = "confidence") -> DataFrame:
        return sample.df.withColumn(name, self.confidence())

    def predict_all(self, sample: Sample, name: str = "prediction") -> DataFrame:
        return sample.df.withColumn(name, self.predict())


class Regressor(ABC):
    """A hypothesis whose prediction is a Column."""

    @abstractmethod
    def predict(self, binned: bool = False) -> Column: ...

    def predict_all(self, sample: Sample, name: str = "prediction") -> DataFrame:
        return sample.df.withColumn(name, self.predict())


@dataclass
class Prepared:
    """A sample as a learner trains on it: rows with y, n (examples that a row stands for) and what the learner needs.

    `binned`: hypotheses are evaluated on bin columns, and rows with equal bins and label may be one.
    """

    df: DataFrame
    m: int
    binned: bool = False
    extra: dict = field(default_factory=dict)


class WeakLearner(ABC):
    """Fits a hypothesis to weighted rows."""

    name: str = ""

    def prepare(self, sample: Sample, keep_rows: bool = False) -> Prepared:
        """Done once; `keep_rows` forbids that rows are put together."""
        df = sample.df.withColumn("n", F.lit(1)).persist()
        return Prepared(df, df.count())

    @abstractmethod
    def produce(self, train: Prepared, weight: Column) -> Classifier | Regressor:
        """`weight` is each example's weight, up to a factor (for a regressor: its present prediction)."""

    def fit(self, sample: Sample, weight: Column | None = None):
        """Prepare and produce, under uniform weights by default."""
        return self.produce(self.prepare(sample), F.lit(1.0) if weight is None else weight)

    def info(self) -> dict[str, str]:
        return {}


def mass(weight: Column) -> Column:
    """The weight of a row's examples together."""
    return F.col("n") * weight


def edge_of(train: Prepared, weight: Column, h: Classifier) -> float:
    """The edge of a hypothesis under weights that needn't add up to 1."""
    if h.edge is not None:
        return h.edge
    w = mass(weight)
    total, value = train.df.agg(F.sum(w), F.sum(w * F.col(TARGET) * h.confidence(train.binned))).first()
    return float(value / total)
