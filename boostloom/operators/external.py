"""Boosting with any model that can be pickled."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from boostloom.operators.base import Classifier, Prepared, WeakLearner
from boostloom.operators.draws import SHARE, Weighted
from boostloom.sources.sample import TARGET, Sample, col

Fit = Callable[[np.ndarray, np.ndarray, np.ndarray], Any]
Score = Callable[[Any, np.ndarray], np.ndarray]


class ExternalClassifier(Classifier):
    """A fitted model whose scores are confidences: clipped to [-1, 1], 0 where the model gives no number.

    The model goes to each executor once, and is unpickled once for each partition.
    """

    def __init__(self, model: bytes, score: Score, features: list[str]):
        self.model, self.score, self.features = model, score, features
        self._shared: Broadcast | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_shared": None}

    def load(self) -> Any:
        return pickle.loads(self.model)

    def confidence(self, binned: bool = False) -> Column:
        if self._shared is None:
            self._shared = SparkSession.active().sparkContext.broadcast(self.model)
        shared, score = self._shared, self.score

        @F.pandas_udf("double")
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = pickle.loads(shared.value)
            for x in parts:
                out = np.asarray(score(model, x.to_numpy(float)), float)
                if out.shape != (len(x),):
                    raise ValueError(f"{len(x)} rows need as many scores, not an array of shape {out.shape}")
                yield pd.Series(np.clip(np.nan_to_num(out, nan=0.0), -1, 1))

        return run(F.struct(*[col(f) for f in self.features]))


class ExternalLearner(WeakLearner):
    """A weak learner from two functions: fit(x, y, weight) -> model, and score(model, x) -> confidences.

    `fit` runs in one task, over about `rows` rows drawn by weight (all, if there are no more); its weights add
    up to about 1 and make what it sees unbiased for the whole sample.  Draws depend on the seed and on the rows'
    ids, not on partitions.  `score` sees a batch of a partition at a time.  A model over `max_bytes` is an error, as it is broadcast.
    """

    name = "External"

    def __init__(self, fit: Fit, score: Score, rows: int = 10_000, seed: int = 1234, max_bytes: int = 64 << 20):
        self._fit, self._score, self._rows, self._seed, self._max = fit, score, rows, seed, max_bytes
        self._draws = 0

    def info(self) -> dict[str, str]:
        return {"rows": str(self._rows), "seed": str(self._seed)}

    def prepare(self, sample: Sample, keep_rows: bool = False) -> Prepared:
        out = super().prepare(sample, keep_rows)
        out.extra["features"] = sample.features
        self._draws = 0
        return out

    def produce(self, train: Prepared, weight: Column) -> ExternalClassifier:
        features, fit, most = train.extra["features"], self._fit, self._max
        whole = Weighted.of(train, weight, features)
        drawn, names = whole.draw(self._rows, self._seed, self._draws), whole.names
        self._draws += 1

        def run(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values([*names, TARGET], kind="stable")  # sums don't depend on how rows came
            model = pickle.dumps(fit(part[names].to_numpy(float), part[TARGET].to_numpy(float), part[SHARE].to_numpy(float)))
            if len(model) > most:
                raise ValueError(f"a model of {len(model)} bytes is over the {most} that may be broadcast")
            return pd.DataFrame({"model": [model]})

        found = drawn.groupBy(F.lit(0).alias("__all")).applyInPandas(run, "model binary").first()
        if found is None:
            raise ValueError("no row was drawn; ask for more rows")
        return ExternalClassifier(bytes(found["model"]), self._score, features)
