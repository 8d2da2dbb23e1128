"""Logged runs and cross-validation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostloom.functions import stats
from boostloom.functions.losses import Objective
from boostloom.operators.base import WeakLearner
from boostloom.plans.base import Booster
from boostloom.sources.sample import ROW, Sample, places

HEADER = ("ObjectiveValue", "TrainLoss", "TestLoss", "Time")


def zero_one(rows: DataFrame, confidence: Column) -> float:
    """The share of rows whose label isn't predicted."""
    return float(rows.agg(stats.zero_one_loss(F.when(confidence >= 0, 1.0).otherwise(-1.0))).first()[0])


def format_unit(value: float) -> str:
    """A number with the unit K, M or G."""
    for unit, size in (("G", 1e9), ("M", 1e6), ("K", 1e3)):
        if abs(value) >= size:
            return f"{value / size:.3f} {unit}"
    return f"{value:.0f}"


def time_format(milliseconds: float) -> str:
    seconds, ms = divmod(milliseconds, 1000)
    minutes, seconds = divmod(int(seconds), 60)
    return f"{minutes} m {seconds:02d} s {ms:03.0f} ms" if minutes else f"{seconds} s {ms:03.0f} ms"


class Logger:
    """Runs a booster and logs objective, train and test loss and boosting time by round.

    `loss(rows, confidence)` is a number; rows of the objective and the losses are the samples' own, each
    scored by a running sum to which a round adds one hypothesis (combinations whose earlier weights
    change are scored anew).
    """

    def __init__(self, booster: Booster, learner: WeakLearner, objective: Objective, loss: Callable[[DataFrame, Column], float], train: Sample, test: Sample, limit_ms: float | None, every: int):
        self.booster, self.learner, self.objective, self.loss = booster, learner, objective, loss
        self.train, self.test, self.limit_ms, self.every = train, test, limit_ms, every
        self.records: list[tuple[float, float, float, float]] = []

    def run(self, path: str | None = None):
        """The combined hypothesis; the log goes to a CSV file if a path is given."""
        self.booster.preprocess(self.learner)
        self.print_stats()
        rows = [s.df.persist() for s in (self.train, self.test)]
        spent, t, self.records = 0.0, 1, []
        while True:
            start = time.perf_counter()
            last = self.booster.boost(self.learner, t)
            spent += (time.perf_counter() - start) * 1000
            if self.booster.hypotheses and not last:
                f = self.booster.current_hypothesis().confidence()
                self.records.append((self.objective.value(rows[0], f), self.loss(rows[0], f), self.loss(rows[1], f), spent))
            over = self.limit_ms is not None and spent >= self.limit_ms
            if last or over:
                print(f"[{'TLE' if over and not last else 'FIN'}] round {t}, {time_format(spent)}")
                break
            if t % self.every == 0:
                o, a, b, _ = self.records[-1]
                print(f"[LOG] round {t}: objective {o:.6f}, train {a:.4f}, test {b:.4f}, {time_format(spent)}")
            t += 1
        if path:
            with open(path, "w") as f:
                f.write(",".join(HEADER) + "\n")
                f.writelines(f"{o},{a},{b},{ms:.0f}\n" for o, a, b, ms in self.records)
        return self.booster.postprocess(self.learner)

    def frame(self) -> DataFrame:
        """The log as rows (round and the header's columns)."""
        return self.train.df.sparkSession.createDataFrame([(i + 1, *map(float, r)) for i, r in enumerate(self.records)], f"round int, {', '.join(f'{c} double' for c in HEADER)}")

    def print_stats(self) -> None:
        for title, facts in (("BOOSTER", self.booster.info()), ("WEAK LEARNER", {"learner": self.learner.name, **self.learner.info()})):
            print(title + ": " + ", ".join(f"{k} {v}" for k, v in facts.items()))
        (m, k), (n, _) = self.train.shape(), self.test.shape()
        print(f"train {format_unit(m)} rows, test {format_unit(n)} rows, {k} features; objective {self.objective.name}")


class LoggerBuilder:
    def __init__(self):
        self._parts: dict = {"limit_ms": None, "every": 100, "loss": zero_one}

    def _set(self, **parts):
        self._parts |= parts
        return self

    def booster(self, booster: Booster):
        return self._set(booster=booster)

    def weak_learner(self, learner: WeakLearner):
        return self._set(learner=learner)

    def objective_function(self, objective: Objective):
        return self._set(objective=objective)

    def loss_function(self, loss: Callable[[DataFrame, Column], float]):
        return self._set(loss=loss)

    def train_sample(self, sample: Sample):
        return self._set(train=sample)

    def test_sample(self, sample: Sample):
        return self._set(test=sample)

    def time_limit_as_millis(self, ms: float):
        return self._set(limit_ms=ms)

    def time_limit_as_secs(self, s: float):
        return self._set(limit_ms=s * 1000)

    def time_limit_as_mins(self, m: float):
        return self._set(limit_ms=m * 60_000)

    def print_every(self, rounds: int):
        return self._set(every=rounds)

    def build(self) -> Logger:
        if missing := {"booster", "learner", "objective", "train", "test"} - set(self._parts):
            raise ValueError(f"still to be set: {', '.join(sorted(missing))}")
        return Logger(**self._parts)


class CrossValidation:
    """Folds of (train, test): fold i tests the places i t to (i + 1) t of the order, t = (1 - train_ratio) m."""

    def __init__(self, sample: Sample):
        self.sample = sample
        self._ratio, self._folds, self._seed, self._shuffle, self._verbose = 0.8, 5, 1234, False, False

    def train_ratio(self, ratio: float):
        if not 0 < ratio < 1:
            raise ValueError("the ratio must lie between 0 and 1")
        self._ratio = ratio
        return self

    def n_folds(self, n: int):
        self._folds = n
        return self

    def seed(self, seed: int):
        self._seed = seed
        return self

    def shuffle(self):
        self._shuffle = True
        return self

    def verbose(self, flag: bool):
        self._verbose = flag
        return self

    def placed(self, name: str = "place") -> DataFrame:
        """Rows with their places in the order: that of row_id, or of its hash with the seed."""
        key = F.xxhash64(F.lit(self._seed), ROW) if self._shuffle else F.col(ROW)
        return places(self.sample.df, key, name)

    def __iter__(self) -> Iterator[tuple[Sample, Sample]]:
        m = self.sample.shape()[0]
        size = max(1, int(round((1 - self._ratio) * m)))
        if self._folds * size >= m + size:
            raise ValueError(f"{self._folds} folds of {size} rows exceed the {m} rows")
        rows = self.placed("__p").persist()
        for i in range(self._folds):
            inside = (F.col("__p") >= i * size) & (F.col("__p") < min((i + 1) * size, m))
            if self._verbose:
                print(f"fold {i + 1} of {self._folds}")
            yield self.sample.with_df(rows.filter(~inside).drop("__p")), self.sample.with_df(rows.filter(inside).drop("__p"))
        rows.unpersist()


