"""The best of several learners."""

from __future__ import annotations

from pyspark.sql import Column

from boostloom.operators.base import Classifier, Prepared, WeakLearner, edge_of
from boostloom.sources.sample import Sample


class LearnerUnion(WeakLearner):
    """Produces with each learner and returns the hypothesis of largest edge; rows are kept, so that all see the same."""

    name = "Union"

    def __init__(self, *learners: WeakLearner):
        self.learners = learners

    def prepare(self, sample: Sample, keep_rows: bool = False) -> Prepared:
        out = self.learners[0].prepare(sample, keep_rows=True)
        for learner in self.learners[1:]:
            more = learner.prepare(sample.with_df(sample.df), keep_rows=True)
            out.extra = more.extra | out.extra
            more.df.unpersist()
        return out

    def produce(self, train: Prepared, weight: Column) -> Classifier:
        found = [learner.produce(train, weight) for learner in self.learners]
        return max(found, key=lambda h: edge_of(train, weight, h))
