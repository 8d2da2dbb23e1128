"""A learner that makes LPBoost take a linear number of rounds."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from boostloom.operators.base import Classifier, Prepared, WeakLearner, mass
from boostloom.sources.sample import ROW, TARGET, Sample


@dataclass
class BadClassifier(Classifier):
    """y times a level that depends on the row's number only: `levels` hold from `starts` on."""

    starts: tuple[int, ...]
    levels: tuple[float, ...]
    edge = None

    def confidence(self, binned: bool = False) -> Column:
        out = F.lit(self.levels[0])
        for start, level in zip(self.starts[1:], self.levels[1:], strict=True):
            out = F.when(F.col(ROW) >= start, F.lit(level)).otherwise(out)
        return out * F.col(TARGET)


def scripted(m: int, tolerance: float, nu: float) -> list[BadClassifier]:
    """ceil(m / 2) + 1 classifiers; each is right on one stretch of rows and almost wrong on the others."""
    half, eps, shift = (m + 1) // 2, tolerance / (2 * m), math.ceil(nu)
    out = [BadClassifier((0, half, half + shift), (1.0, -1 + 2 * eps, -1 + 3 * eps))]
    for k in range(half - 1):
        gap, at = 5.0 + 2 * k, half + k
        if eps * gap > 1:
            raise ValueError("the tolerance is too large for the number of rows")
        out.append(BadClassifier((0, at, at + shift, at + 2 * shift), (-1 + gap * eps, 1.0, -1 + (gap - 1) * eps, -1 + gap * eps)))
    return [*out, BadClassifier((0, half), (-1 + eps, 1 - eps))]


class BadBaseLearner(WeakLearner):
    """Returns the scripted classifier of largest edge; needs row_id 0, 1, ...

    An edge is a sum over at most four stretches of rows, so the weights' running sums at the stretches'
    ends are all that is taken from the rows: one aggregate by stretch, not one for each classifier.
    """

    name = "Bad Learner for LPBoost"

    def __init__(self, tolerance: float = 1e-9, nu: float = 1.0):
        self._tolerance, self._nu = tolerance, nu

    def tolerance(self, value: float):
        self._tolerance = value
        return self

    def nu(self, value: float):
        self._nu = value
        return self

    def build(self):
        return self

    def prepare(self, sample: Sample, keep_rows: bool = False) -> Prepared:
        out = super().prepare(sample, keep_rows)
        if not 1 <= self._nu <= out.m:
            raise ValueError("nu must lie between 1 and the number of rows")
        out.extra["classifiers"] = scripted(out.m, self._tolerance, self._nu)
        return out

    def edges(self, train: Prepared, weight: Column) -> pd.DataFrame:
        """classifier, edge for all of them."""
        classifiers = train.extra["classifiers"]
        cuts = np.unique([s for h in classifiers for s in h.starts])
        # every row from the first cut over 0 on may start a stretch, those before never do
        first = int(cuts[1]) if len(cuts) > 1 else train.m
        stretch = F.when(F.col(ROW) < first, F.lit(0)).when(F.col(ROW) <= int(cuts[-1]), F.col(ROW)).otherwise(F.lit(int(cuts[-1])))
        sums = train.df.groupBy(stretch.alias("at")).agg(F.sum(mass(weight) * F.col(TARGET) * F.col(TARGET)).alias("w")).toPandas().sort_values("at")
        at, running = sums["at"].to_numpy(), np.r_[0.0, np.cumsum(sums["w"].to_numpy(float))]
        under = lambda s: running[np.searchsorted(at, s)]
        edges = []
        for h in classifiers:
            ends = [under(s) for s in h.starts] + [running[-1]]
            edges.append(sum(v * (b - a) for v, a, b in zip(h.levels, ends, ends[1:], strict=False)))
        return pd.DataFrame({"classifier": np.arange(len(classifiers)), "edge": np.array(edges) / running[-1]})

    def produce(self, train: Prepared, weight: Column) -> BadClassifier:
        table = self.edges(train, weight)
        return train.extra["classifiers"][int(table["edge"].to_numpy().argmax())]
