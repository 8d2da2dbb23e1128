"""Combinations of hypotheses."""

from __future__ import annotations

import json


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boostloom.operators.base import Classifier, Regressor
from boostloom.sources.sample import TARGET, Sample


def _sum(columns: list[Column]) -> Column:
    """A balanced sum, so that expressions stay shallow."""
    while len(columns) > 1:
        columns = [columns[i] + columns[i + 1] if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    return columns[0] if columns else F.lit(0.0)


class WeightedMajority(Classifier, Regressor):
    """A weighted sum of hypotheses: of confidences, or of predictions if they are regressors."""

    def __init__(self, weights: list[float] | None = None, hypotheses: list | None = None):
        self.weights, self.hypotheses = list(weights or []), list(hypotheses or [])

    @staticmethod
    def from_slices(weights: list[float], hypotheses: list) -> WeightedMajority:
        """Keep positive weights and divide them by their sum."""
        kept = [(w, h) for w, h in zip(weights, hypotheses, strict=True) if w > 0]
        if not kept:
            raise ValueError("no hypothesis has a positive weight; a learner whose edges are negative can't be boosted")
        return WeightedMajority([w for w, _ in kept], [h for _, h in kept]).normalize()

    def push(self, weight: float, h) -> None:
        self.weights.append(weight)
        self.hypotheses.append(h)

    def normalize(self) -> WeightedMajority:
        total = sum(abs(w) for w in self.weights)
        if not total:
            raise ValueError("the weights add up to 0")
        self.weights = [w / total for w in self.weights]
        return self

    def decompose(self) -> tuple[list[float], list]:
        return self.weights, self.hypotheses

    @property
    def regression(self) -> bool:
        return bool(self.hypotheses) and not isinstance(self.hypotheses[0], Classifier)

    def confidence(self, binned: bool = False) -> Column:
        return _sum([F.lit(float(w)) * h.confidence(binned) for w, h in zip(self.weights, self.hypotheses, strict=True)])

    def predict(self, binned: bool = False) -> Column:
        if self.regression:
            return _sum([F.lit(float(w)) * h.predict(binned) for w, h in zip(self.weights, self.hypotheses, strict=True)])
        return Classifier.predict(self, binned)

    def score(self, rows: DataFrame, name: str = "confidence", at_once: int = 32) -> DataFrame:
        """Add the sum as a column, `at_once` hypotheses in one expression (generated code is limited in size)."""
        out = rows.withColumn(name, F.lit(0.0))
        for a in range(0, len(self.weights), at_once):
            part = WeightedMajority(self.weights[a : a + at_once], self.hypotheses[a : a + at_once])
            out = out.withColumn(name, F.col(name) + (part.predict() if self.regression else part.confidence()))
        return out

    def to_json(self) -> str:
        return json.dumps({"kind": "weighted_majority", "weights": self.weights, "hypotheses": [json.loads(h.to_json()) for h in self.hypotheses]})

    @staticmethod
    def from_json(text: str) -> WeightedMajority:
        from boostloom.operators.serial import from_dict

        return from_dict(json.loads(text))


class NaiveAggregation(Classifier):
    """+1 where the labels that the hypotheses predict occur together on a positive training row, else -1.

    Build with `learned`, which collects the predictions' signatures of the positive rows into a table;
    it is joined by signature, so that nothing needs to fit into one process.
    """

    def __init__(self, hypotheses: list[Classifier], signatures: DataFrame):
        self.hypotheses, self.signatures = list(hypotheses), signatures

    @staticmethod
    def learned(hypotheses: list[Classifier], rows: DataFrame, binned: bool = False) -> NaiveAggregation:
        positive = rows.filter(F.col(TARGET) > 0).select(NaiveAggregation.signature(hypotheses, binned).alias("signature")).distinct()
        return NaiveAggregation(hypotheses, positive)

    @staticmethod
    def from_slice(hypotheses: list[Classifier], signatures: DataFrame) -> NaiveAggregation:
        return NaiveAggregation(hypotheses, signatures)

    @staticmethod
    def of(hypotheses: list[Classifier], signatures: list[str]) -> NaiveAggregation:
        """From a list of signatures, as JSON has them."""
        rows = SparkSession.active().createDataFrame([(s,) for s in signatures], "signature string")
        return NaiveAggregation(hypotheses, rows)

    def _known(self) -> list[str]:
        known = [r[0] for r in self.signatures.limit(10_001).collect()]
        if len(known) > 10_000:
            raise ValueError("too many signatures for a list; use predict_rows()")
        return known

    def to_json(self) -> str:
        """Only for few signatures, as confidence()."""
        return json.dumps({"kind": "naive_aggregation", "hypotheses": [json.loads(h.to_json()) for h in self.hypotheses], "signatures": sorted(self._known())})

    @staticmethod
    def signature(hypotheses: list[Classifier], binned: bool = False) -> Column:
        bits = [F.when(h.confidence(binned) >= 0, "1").otherwise("0") for h in hypotheses]
        return F.concat(*bits) if bits else F.lit("")

    def confidence(self, binned: bool = False) -> Column:
        """Only for few signatures: they become a list in the expression.  predict_rows() has no such bound."""
        known = self._known()
        return F.when(self.signature(self.hypotheses, binned).isin(known), 1.0).otherwise(-1.0) if known else F.lit(-1.0)

    def predict_rows(self, rows: DataFrame, name: str = "prediction", binned: bool = False) -> DataFrame:
        of = self.signatures.select(F.col("signature").alias("__s"), F.lit(1).alias("__hit"))
        joined = rows.withColumn("__sig", self.signature(self.hypotheses, binned)).join(of, F.col("__sig") == F.col("__s"), "left")
        return joined.withColumn(name, F.when(F.col("__hit").isNull(), -1).otherwise(1)).drop("__sig", "__s", "__hit")

    def predict_all(self, sample: Sample, name: str = "prediction") -> DataFrame:
        return self.predict_rows(sample.df, name)


