"""Split criteria over cumulative label masses, for arrays and for Columns alike.

A criterion scores a cut from the masses of +1 and -1 on its left and of the whole node; smaller is
better.  `parent` is what a cut must stay under.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ARRAYS = SimpleNamespace(log=lambda x: np.log(np.maximum(x, 1e-300)), abs=np.abs, where=np.where)
COLUMNS = SimpleNamespace(log=lambda x: F.log(F.greatest(x, F.lit(1e-300))), abs=F.abs, where=lambda c, a, b: F.when(c, a).otherwise(b))


def _entropy(m: Any, p: Any, t: Any) -> Any:
    q = m.where(t > 0, p / m.where(t > 0, t, t + 1.0), p * 0.0)
    r = 1.0 - q
    return -(m.where(q > 0, q * m.log(q), q * 0.0) + m.where(r > 0, r * m.log(r), r * 0.0))


def _gini(m: Any, p: Any, t: Any) -> Any:
    q = m.where(t > 0, p / m.where(t > 0, t, t + 1.0), p * 0.0)
    return 2.0 * q * (1.0 - q)


@dataclass
class Criterion:
    name: str
    score: Callable[[Any, Any, Any, Any, Any], Any]
    parent: Callable[[Any, Any, Any], Any]


def _impurity(name: str, of: Callable[[Any, Any, Any], Any]) -> Criterion:
    def score(m, lp, ln, tp, tn):
        lt, t = lp + ln, tp + tn
        return (lt / t) * of(m, lp, lt) + ((t - lt) / t) * of(m, tp - lp, t - lt)

    return Criterion(name, score, lambda m, tp, tn: of(m, tp, tp + tn))


def _edge(m, lp, ln, tp, tn):
    return -m.abs(((tp - lp) - (tn - ln) - lp + ln) / (tp + tn))


def _twoing(m, lp, ln, tp, tn):
    t = tp + tn
    l, r = (lp + ln) / t, 1.0 - (lp + ln) / t
    a = m.where((l > 0) & (r > 0), l, l * 0.0 + 1.0)
    b = m.where((l > 0) & (r > 0), r, l * 0.0 + 1.0)
    apart = m.abs(lp / t / a - (tp - lp) / t / b) + m.abs(ln / t / a - (tn - ln) / t / b)
    return m.where((l > 0) & (r > 0), -(apart * apart) * l * r / 4.0, l * 0.0)


ENTROPY = _impurity("entropy", _entropy)
GINI = _impurity("gini", _gini)
EDGE = Criterion("edge", _edge, lambda m, tp, tn: 0.0)
TWOING = Criterion("twoing", _twoing, lambda m, tp, tn: 0.0)
CRITERIA = {c.name: c for c in (ENTROPY, GINI, EDGE, TWOING)}


def best_cut(criterion: Criterion, positive: np.ndarray, negative: np.ndarray) -> tuple[float, int]:
    """(score, position of the last bin on the left) over occupied bins in order; ties go to the first cut."""
    tp, tn = positive.sum(), negative.sum()
    score = criterion.score(ARRAYS, np.cumsum(positive)[:-1], np.cumsum(negative)[:-1], tp, tn)
    at = int(np.argmin(np.round(score, 10)))
    return float(np.round(score[at], 10)), at


def best_splits(histogram: DataFrame, criterion: Criterion) -> DataFrame:
    """The same as a plan: from (node, feature, bin, positive, negative) to one row for each node that can be split.

    node, feature, bin, next_bin, score, parent.  Running sums go over a node's bins, and the best row is
    taken by (score, feature, bin): both partition by node, whatever the number of nodes.
    """
    order = Window.partitionBy("node", "feature").orderBy("bin")
    running, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("node", "feature")
    masses = histogram.select(
        "node", "feature", "bin", F.lead("bin").over(order).alias("next_bin"),
        F.sum("positive").over(running).alias("lp"), F.sum("negative").over(running).alias("ln"),
        F.sum("positive").over(whole).alias("tp"), F.sum("negative").over(whole).alias("tn"),
    ).filter("next_bin is not null")
    parts = [F.col(c) for c in ("lp", "ln", "tp", "tn")]
    parent = criterion.parent(COLUMNS, F.col("tp"), F.col("tn"))
    scored = masses.select("node", "feature", "bin", "next_bin", F.round(criterion.score(COLUMNS, *parts), 10).alias("score"), (parent if not isinstance(parent, float) else F.lit(parent)).alias("parent"))
    first = F.min(F.struct("score", "feature", "bin", "next_bin", "parent")).alias("b")
    return scored.groupBy("node").agg(first).select("node", "b.feature", "b.bin", "b.next_bin", "b.score", "b.parent")
