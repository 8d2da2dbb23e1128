"""A small feed-forward network: minibatches are drawn in Spark by weight, trained on the driver, scored in batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from boostloom.operators.base import Classifier, Prepared, Regressor, WeakLearner, mass
from boostloom.sources.sample import TARGET, Sample, col


@dataclass(frozen=True)
class Activation:
    """softmax(eta), sigmoid(eta), relu(threshold) or id, with the derivative by the input."""

    kind: str
    value: float = 1.0

    def __call__(self, u: np.ndarray) -> np.ndarray:
        if self.kind == "softmax":
            e = np.exp(self.value * (u - u.max(1, keepdims=True)))
            return e / e.sum(1, keepdims=True)
        if self.kind == "sigmoid":
            return 1 / (1 + np.exp(-np.clip(self.value * u, -700, 700)))
        return np.where(u > self.value, u, 0.0) if self.kind == "relu" else u

    def slope(self, u: np.ndarray) -> np.ndarray:
        if self.kind in ("softmax", "sigmoid"):
            z = self(u)
            return self.value * z * (1 - z)
        return (u > self.value).astype(float) if self.kind == "relu" else np.ones_like(u)


def softmax(eta: float = 1.0) -> Activation:
    return Activation("softmax", eta)


def sigmoid(eta: float = 1.0) -> Activation:
    return Activation("sigmoid", eta)


def relu(threshold: float = 0.0) -> Activation:
    return Activation("relu", threshold)


def identity() -> Activation:
    return Activation("id")


def one_hot(y: np.ndarray, n: int) -> np.ndarray:
    """Labels of 0 or less are class 0, others class 1; a single output is 1 for class 1."""
    hot = (y > 0).astype(int)
    return hot[:, None].astype(float) if n == 1 else np.eye(n)[np.minimum(hot, n - 1)]


@dataclass(frozen=True)
class NNLoss:
    """A network's loss, squares or cross entropy: its mean over rows, and its gradient by the last layer's input.

    With softmax or sigmoid outputs for cross entropy, and id for squares, that gradient is p - target.
    """

    kind: str = "cross_entropy"

    def value(self, p: np.ndarray, target: np.ndarray) -> float:
        return float(self.by_row(p, target).mean())

    def by_row(self, p: np.ndarray, target: np.ndarray) -> np.ndarray:
        if self.kind == "l2":
            return ((p - target) ** 2).sum(1) / 2
        if target.shape[1] == 1:
            p, target = np.c_[1 - p, p], np.c_[1 - target, target]
        return -(target * np.log(np.maximum(p, 1e-300))).sum(1)

    def gradient(self, p: np.ndarray, target: np.ndarray) -> np.ndarray:
        return p - target


L2, CROSS_ENTROPY = NNLoss("l2"), NNLoss("cross_entropy")


class Network:
    """Layers of matrices with a bias."""

    def __init__(self, dims: list[int], activations: list[Activation], rng: np.random.Generator, scale: float = 5.0):
        self.activations = activations
        self.weights = [rng.normal(0, scale, (a, b)) / np.sqrt(a) for a, b in zip(dims, dims[1:], strict=False)]
        self.bias = [np.zeros(b) for b in dims[1:]]

    def forward(self, x: np.ndarray) -> np.ndarray:
        for w, b, f in zip(self.weights, self.bias, self.activations, strict=True):
            x = f(x @ w + b)
        return x

    def to_dict(self) -> dict:
        return {"activations": [[f.kind, f.value] for f in self.activations], "weights": [w.tolist() for w in self.weights], "bias": [b.tolist() for b in self.bias]}

    @staticmethod
    def from_dict(d: dict) -> Network:
        out = Network([], [Activation(*f) for f in d["activations"]], np.random.default_rng(0))
        out.weights, out.bias = [np.array(w, float) for w in d["weights"]], [np.array(b, float) for b in d["bias"]]
        return out

    def train(self, x: np.ndarray, target: np.ndarray, rate: float, loss: NNLoss = CROSS_ENTROPY) -> None:
        """One gradient step against the loss."""
        self.move(-rate * self.gradient(x, target, loss))

    def gradient(self, x: np.ndarray, target: np.ndarray, loss: NNLoss, weight: np.ndarray | None = None) -> np.ndarray:
        """The gradient of the loss, summed over rows (by their weights), in the order of flat()."""
        inputs, sums = [], []
        for w, b, f in zip(self.weights, self.bias, self.activations, strict=True):
            inputs.append(x)
            sums.append(x @ w + b)
            x = f(sums[-1])
        delta = loss.gradient(x, target)
        if weight is not None:
            delta = delta * weight[:, None]
        out = []
        for i in reversed(range(len(self.weights))):
            out += [delta.sum(0), (inputs[i].T @ delta).ravel()]
            if i:
                delta = (delta @ self.weights[i].T) * self.activations[i - 1].slope(sums[i - 1])
        return np.concatenate(out[::-1])

    def flat(self) -> np.ndarray:
        """All weights: a layer's matrix by rows, then its bias, layer after layer."""
        return np.concatenate([a for w, b in zip(self.weights, self.bias, strict=True) for a in (w.ravel(), b)])

    def move(self, by: np.ndarray) -> None:
        """Add to all weights, in the order of flat()."""
        at = 0
        for i, (w, b) in enumerate(zip(self.weights, self.bias, strict=True)):
            self.weights[i] = w + by[at : at + w.size].reshape(w.shape)
            self.bias[i] = b + by[at + w.size : at + w.size + b.size]
            at += w.size + b.size

    def stats(self) -> dict[str, float]:
        flat = np.concatenate([w.ravel() for w in self.weights])
        return {"mean": float(flat.mean()), "min": float(flat.min()), "max": float(flat.max()), "n": float(flat.size)}


class _Scored:
    kind = ""

    def __init__(self, network: Network, features: list[str]):
        self.network, self.features = network, features

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "features": self.features, "network": self.network.to_dict()})


class NetworkClassifier(_Scored, Classifier):
    kind = "network_classifier"

    def confidence(self, binned: bool = False) -> Column:
        network = self.network

        @F.pandas_udf("double")
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for x in parts:
                out = network.forward(x.to_numpy(float))
                score = 2 * out[:, 0] - 1 if out.shape[1] == 1 else out[:, 1] - out[:, 0]
                yield pd.Series(np.clip(score, -1, 1))

        return run(F.struct(*[col(f) for f in self.features]))


class NetworkRegressor(_Scored, Regressor):
    kind = "network_regressor"

    def predict(self, binned: bool = False) -> Column:
        network = self.network

        @F.pandas_udf("double")
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for x in parts:
                yield pd.Series(network.forward(x.to_numpy(float))[:, 0])

        return run(F.struct(*[col(f) for f in self.features]))


class NeuralNetwork(WeakLearner):
    """append(dim, activation), n_epoch, n_iter, minibatch_size; task "binary" or "regression".

    An epoch's minibatch is a weighted sample without replacement, the rows of the least -ln(u) / weight,
    drawn by a top-k plan; so at most minibatch_size rows reach the driver whatever the table's size.
    With in_partitions() no row reaches it: minibatches stay where they are and a step is one aggregate.
    """

    name = "Neural Network"

    def __init__(self, seed: int = 1234, task: str = "binary"):
        self._layers: list[tuple[int, Activation]] = []
        self._epochs, self._iterations, self._batch, self._rate = 100, 200, 128, 1e-3
        self._seed, self._task = seed, task
        self._parallel, self._scale = False, 5.0
        self.trace: list = []

    def append(self, dim: int, activation: Activation):
        self._layers.append((dim, activation))
        return self

    def n_epoch(self, n: int):
        self._epochs = n
        return self

    def n_iter(self, n: int):
        self._iterations = n
        return self

    def minibatch_size(self, n: int):
        self._batch = n
        return self

    def task(self, task: str):
        self._task = task
        return self

    def learning_rate(self, rate: float):
        """Of the mean gradient over a minibatch."""
        self._rate = rate
        return self

    def initial_scale(self, scale: float):
        """Standard deviation of the first weights, times the root of a layer's inputs."""
        self._scale = scale
        return self

    def in_partitions(self, flag: bool = True):
        """Train by steps over minibatches that stay in their partitions.

        An epoch draws about minibatch_size rows by weight (all, by their weights, if there are no more), and each of
        its n_iter steps is a job, so this is for large minibatches and few steps.  `trace` then has the steps.
        """
        self._parallel = flag
        return self

    def info(self) -> dict[str, str]:
        return {"task": self._task, "minibatch": str(self._batch), "epochs": str(self._epochs), "layers": str(len(self._layers))}

    def prepare(self, sample: Sample, keep_rows: bool = False) -> Prepared:
        out = super().prepare(sample, keep_rows)
        out.extra["features"] = sample.features
        return out

    def produce(self, train: Prepared, weight: Column) -> NetworkClassifier | NetworkRegressor:
        features, batch = train.extra["features"], self._batch
        if self._parallel:
            return self._produce_in_partitions(train, weight, features)
        while batch > train.m:
            batch //= 2
        rng = np.random.default_rng(self._seed)
        network = Network([len(features), *[d for d, _ in self._layers]], [a for _, a in self._layers], rng, self._scale)
        out = self._layers[-1][0]
        # one draw serves all epochs: a row may be in several of them
        w = mass(weight)
        keys = [F.when(w > 0, -F.log(F.rand(self._seed + e)) / w) for e in range(self._epochs)]
        for start in range(0, self._epochs, 10):
            draws = [train.df.filter(w > 0).withColumn("__k", k).orderBy("__k").limit(batch).select(F.lit(e).alias("__e"), *[col(f) for f in features], TARGET) for e, k in list(enumerate(keys))[start : start + 10]]
            rows = draws[0]
            for d in draws[1:]:
                rows = rows.unionByName(d)
            for _, part in rows.toPandas().groupby("__e", sort=True):
                x, y = part[features].to_numpy(float), part[TARGET].to_numpy(float)
                target = one_hot(y, out) if self._task == "binary" else y[:, None]
                for _ in range(self._iterations):
                    network.train(x, target, self._rate / batch, CROSS_ENTROPY if self._task == "binary" else L2)
        return NetworkClassifier(network, features) if self._task == "binary" else NetworkRegressor(network, features)

    def _produce_in_partitions(self, train: Prepared, weight: Column, features: list[str]) -> NetworkClassifier | NetworkRegressor:
        from boostloom.operators.draws import Weighted
        from boostloom.operators.parallel import descend

        network = Network([len(features), *[d for d, _ in self._layers]], [a for _, a in self._layers], np.random.default_rng(self._seed), self._scale)
        loss = CROSS_ENTROPY if self._task == "binary" else L2
        whole, self.trace = Weighted.of(train, weight, features), []
        for epoch in range(self._epochs):
            rows = whole.draw(self._batch, self._seed, epoch).persist()
            network, steps = descend(rows, whole.names, network, loss, self._rate, self._iterations)
            rows.unpersist()
            self.trace += steps
        return NetworkClassifier(network, features) if self._task == "binary" else NetworkRegressor(network, features)
