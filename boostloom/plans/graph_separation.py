"""Graph separation boosting: weights are degrees in the graph of rows that aren't told apart yet."""

from __future__ import annotations

import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from boostloom.operators.base import WeakLearner
from boostloom.operators.combined import NaiveAggregation
from boostloom.plans.base import Booster
from boostloom.lineage import cut
from boostloom.sources.sample import TARGET, Sample


#: Hypotheses up to which the table of signatures is broadcast: rows of one signature then needn't meet.
FEW = 16


class GraphSepBoost(Booster):
    """Two rows are joined while their labels differ and all hypotheses predict the same for both.

    The graph isn't built: a row's degree is the number of rows of the other label with its signature,
    which one aggregate by (signature, label) gives.
    """

    name = "Graph Separation Boosting"

    def __init__(self, sample: Sample):
        super().__init__(sample)
        self.edges_left: list[int] = []

    def preprocess(self, learner: WeakLearner) -> None:
        super().preprocess(learner)
        self.train.df = self.train.df.withColumn("__sig", F.lit(""))
        self.edges_left = []

    def _with_degrees(self):
        """Rows with the number of joined rows, and the number of edges."""
        df = self.train.df.drop("__degree")
        of = df.groupBy("__sig").agg(F.sum(F.when(F.col(TARGET) > 0, F.col("n")).otherwise(0)).alias("__pos"), F.sum(F.when(F.col(TARGET) > 0, 0).otherwise(F.col("n"))).alias("__neg"))
        of = of.withColumnRenamed("__sig", "__s")
        if len(self.hypotheses) <= FEW:  # 2 ** FEW signatures at most
            of = F.broadcast(of)
        rows = df.join(of, F.col("__sig") == F.col("__s")).withColumn("__degree", F.when(F.col(TARGET) > 0, F.col("__neg")).otherwise(F.col("__pos"))).drop("__s", "__pos", "__neg")
        return rows

    def boost(self, learner: WeakLearner, t: int) -> bool:
        old = self.train.df
        self.train.df = cut(self._with_degrees())
        old.unpersist()
        left = int(self.train.df.agg(F.sum(F.col("n") * F.col("__degree"))).first()[0] or 0) // 2
        if not left:
            return True
        if self.edges_left and left >= self.edges_left[-1]:
            warnings.warn("the last hypothesis separated no rows; boosting ends", stacklevel=2)
            return True
        self.edges_left.append(left)
        h = learner.produce(self.train, F.col("__degree").cast("double"))
        self.hypotheses.append(h)
        self.weights.append(1.0)
        bit = F.when(h.confidence(self.train.binned) >= 0, "1").otherwise("0")
        self.train.df = self.train.df.withColumn("__sig", F.concat("__sig", bit))
        self.rounds = t
        return False

    def current_hypothesis(self) -> NaiveAggregation:
        positive = self.train.df.filter(F.col(TARGET) > 0).select(F.col("__sig").alias("signature")).distinct()
        return NaiveAggregation(self.hypotheses, positive)

    def confidence(self) -> Column:
        return self.current_hypothesis().confidence(self.train.binned)
