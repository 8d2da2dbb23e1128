"""Training a network where its rows are.

A step is one aggregate: each partition adds up its rows' gradients as a vector, the vectors are added up by
position, and the driver sees as many numbers as the network has weights.  Rows never leave their partitions, the
network goes out with each step, and a lost executor's partitions are simply computed again.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostloom.operators.draws import SHARE
from boostloom.operators.neural import L2, Network, NNLoss, one_hot
from boostloom.sources.sample import TARGET


@dataclass
class Step:
    """What a step saw and did: the loss and its gradient before it, and the weights after it, in the order of Network.flat()."""

    loss: float
    gradient: np.ndarray
    weights: np.ndarray


def targets(y: np.ndarray, outputs: int, loss: NNLoss) -> np.ndarray:
    return y[:, None] if loss == L2 else one_hot(y, outputs)


def gradient(rows: DataFrame, features: list[str], network: Network, loss: NNLoss) -> tuple[float, np.ndarray]:
    """The loss and its gradient by all weights, summed over the rows by their shares; no rows give zeros."""
    size, outputs = len(network.flat()), len(network.bias[-1])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, value, seen = np.zeros(size), 0.0, False
        for part in parts:
            if len(part):
                x, share = part[features].to_numpy(float), part[SHARE].to_numpy(float)
                target = targets(part[TARGET].to_numpy(float), outputs, loss)
                total += network.gradient(x, target, loss, share)
                value += float(share @ loss.by_row(network.forward(x), target))
                seen = True
        if seen:
            yield pd.DataFrame({"i": np.arange(size + 1), "g": np.r_[total, value]})

    sums = rows.mapInPandas(run, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
    out = np.zeros(size + 1)
    for i, g in sums:
        out[i] = g
    return float(out[-1]), out[:-1]


def descend(rows: DataFrame, features: list[str], network: Network, loss: NNLoss, rate: float, steps: int) -> tuple[Network, list[Step]]:
    """So many gradient steps over the same rows; the network given stays as it is."""
    network, trace = copy.deepcopy(network), []
    for _ in range(steps):
        value, g = gradient(rows, features, network, loss)
        network.move(-rate * g)
        trace.append(Step(value, g, network.flat()))
    return network, trace
