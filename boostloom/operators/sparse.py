"""Trees on sparse rows: histograms come from the entries that there are, zeros by difference.

Rows hold a map of index to value, as read_svmlight() gives it; an index that a row lacks is 0 there.  No column
is made for a feature: bins are a table with a row for each feature that occurs, a level of the tree is one
aggregate over entries by (node, feature, bin), and what a node's rows lack of a feature is the node's totals
less the feature's sums.  Work follows the entries, and the driver sees the best cut of each open node only.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostloom.functions.losses import L2, Loss
from boostloom.operators.base import Classifier, Prepared, Regressor, WeakLearner, mass
from boostloom.operators.binning import EPSILON, MOST_BINS
from boostloom.operators.criteria import CRITERIA, Criterion, best_splits
from boostloom.sources.sample import TARGET, Sample

ENTRIES = "features"
#: Features up to which their bins are broadcast.
FEW_FEATURES = 100_000
#: Parts of a feature's entries that meet its row apart from each other, where that isn't broadcast: a feature may be in all rows.
SPREAD = 16


def with_feature(entries: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """Entries (feature, value, ...) with the row of their feature in a table with one for each, which has column names of its own."""
    if few:
        return entries.join(F.broadcast(table), "feature")
    salted = entries.withColumn("__salt", F.pmod(F.xxhash64(*entries.columns), F.lit(SPREAD)))
    spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return salted.join(spread, ["feature", "__salt"]).drop("__salt")


def sparse_sample(rows: DataFrame) -> Sample:
    """A sample over rows with a target and a map `features` of int to double; null values count as 0."""
    return Sample(rows, [ENTRIES])


def value_of(feature: int) -> Column:
    return F.coalesce(F.col(ENTRIES)[F.lit(feature)], F.lit(0.0))


def _entries(rows: DataFrame, *columns: str | Column) -> DataFrame:
    return rows.select(*columns, F.explode(ENTRIES).alias("feature", "value")).filter(F.col("value") != 0)


def sparse_bins(rows: DataFrame, m: int) -> DataFrame:
    """feature, low, width, n of equal-width bins, and the bin of 0, for each index with a value other than 0 in the `m` rows."""
    found = _entries(rows).groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.countDistinct("value").alias("d"), F.count(F.lit(1)).alias("k"))
    lacking = F.col("k") < m
    found = found.select("feature", F.when(lacking, F.least("a", F.lit(0.0))).otherwise(F.col("a")).alias("a"), F.when(lacking, F.greatest("b", F.lit(0.0))).otherwise(F.col("b")).alias("b"), (F.col("d") + lacking.cast("int")).alias("d"))
    flat = (F.col("a") == F.col("b")).cast("int") * EPSILON
    n = F.least(F.col("d"), F.lit(MOST_BINS)).cast("int")
    bins = found.select("feature", (F.col("a") - flat).alias("low"), ((F.col("b") - F.col("a") + 2 * flat) / n).alias("width"), n.alias("n"))
    return bins.withColumn("zero", _bin(F.lit(0.0)))


def _bin(value: Column) -> Column:
    return F.greatest(F.least(F.floor((value - F.col("low")) / F.col("width")), F.col("n") - 1), F.lit(0)).cast("int")


def sparse_histogram(rows: DataFrame, bins: DataFrame, few: bool, node: Column, positive: Column, negative: Column) -> DataFrame:
    """node, feature, bin, positive, negative, for rows whose node isn't negative.

    `few`: the bins' table is small enough to broadcast, which the caller has counted.
    """
    inside = rows.select(node.alias("node"), positive.alias("positive"), negative.alias("negative"), ENTRIES).filter("node >= 0")
    totals = inside.groupBy("node").agg(F.sum("positive").alias("tp"), F.sum("negative").alias("tn"), F.count(F.lit(1)).alias("rows"))
    flat = with_feature(_entries(inside, "node", "positive", "negative"), bins, few)
    sums = flat.groupBy("node", "feature", _bin(F.col("value")).alias("bin")).agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"), F.count(F.lit(1)).alias("k"), F.first("zero").alias("zero"))
    held = sums.groupBy("node", "feature").agg(F.sum("positive").alias("p"), F.sum("negative").alias("q"), F.sum("k").alias("k"), F.first("zero").alias("zero"))
    lacking = held.join(F.broadcast(totals), "node").filter("k < rows")  # a row for each open node
    zeros = lacking.select("node", "feature", F.col("zero").alias("bin"), (F.col("tp") - F.col("p")).alias("positive"), (F.col("tn") - F.col("q")).alias("negative"))
    both = sums.select("node", "feature", "bin", "positive", "negative").union(zeros)
    return both.groupBy("node", "feature", "bin").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


class _SparseTree:
    """A tree whose branches are (feature, threshold, left, right) and whose leaves are numbers."""

    def __init__(self, root: tuple | float):
        self.root = root

    def column(self) -> Column:
        def walk(node: tuple | float) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            return F.when(value_of(node[0]) < node[1], walk(node[2])).otherwise(walk(node[3]))

        return walk(self.root)

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "root": self.root})


class SparseTree(_SparseTree, Classifier):
    """Leaves are confidences."""

    kind = "sparse_tree"

    def confidence(self, binned: bool = False) -> Column:
        return self.column()


class SparseRegressor(_SparseTree, Regressor):
    """Leaves are predictions."""

    kind = "sparse_regressor"
    regression = True

    def predict(self, binned: bool = False) -> Column:
        return self.column()


def tree_of(root: list | tuple | float) -> tuple | float:
    """A root as JSON has it."""
    return (root[0], root[1], tree_of(root[2]), tree_of(root[3])) if isinstance(root, list | tuple) else root


class _SparseLearner(WeakLearner):
    """Grows trees level by level from two sums by (node, feature, bin)."""

    def prepare(self, sample: Sample, keep_rows: bool = False) -> Prepared:
        out = super().prepare(sample, keep_rows)
        bins = sparse_bins(out.df, out.m).persist()
        out.extra |= {"bins": bins, "few": bins.count() <= FEW_FEATURES}
        return out

    def _leaf(self, p: float, q: float) -> float:
        raise NotImplementedError

    def _open(self, p: float, q: float) -> bool:
        """Can a node with these sums be split?"""
        raise NotImplementedError

    def _grow(self, rows: DataFrame, train: Prepared, sums: list[Column], levels: int, criterion: Criterion) -> tuple[tuple | float, list[tuple[float, float]]]:
        """The root, and the leaves' sums."""
        bins = train.extra["bins"]
        cuts: dict[tuple, tuple[int, float]] = {}  # by path: the sides taken from the root
        masses: dict[tuple, tuple[float, float]] = {}
        frontier: list[tuple] = [()]

        def place(path: tuple = ()) -> Column:
            if path in cuts:
                feature, threshold = cuts[path]
                return F.when(value_of(feature) < threshold, place((*path, 0))).otherwise(place((*path, 1)))
            return F.lit(frontier.index(path) if path in frontier else -1)

        for level in range(levels + 1):
            totals = rows.withColumn("__node", place()).filter("__node >= 0").groupBy("__node").agg(F.sum(sums[0]), F.sum(sums[1])).collect()
            for i, p, q in totals:
                masses[frontier[i]] = (float(p), float(q))
            if not masses:
                raise ValueError("no row has a positive weight")
            following = [path for path in frontier if path in masses and self._open(*masses[path])]
            if level == levels or not following:
                break
            frontier = following
            table = sparse_histogram(rows, bins, train.extra["few"], place(), *sums)
            best = best_splits(table, criterion).filter("score < parent")
            best = best.join(bins, "feature")
            threshold = F.col("low") + F.col("width") * (F.col("bin") + 1 + F.col("next_bin")) / 2
            following = []
            for node, feature, at in best.select("node", "feature", threshold.alias("at")).collect():
                cuts[frontier[node]] = (feature, at)
                following += [(*frontier[node], 0), (*frontier[node], 1)]
            if not following:
                break
            frontier = following

        def grown(path: tuple = ()) -> tuple | float:
            if path in cuts:
                return (*cuts[path], grown((*path, 0)), grown((*path, 1)))
            return self._leaf(*masses.get(path, (0.0, 0.0)))

        return grown(), [m for path, m in masses.items() if path not in cuts]


class SparseDecisionTree(_SparseLearner):
    """Trees of `max_depth` levels of splits, the same as DecisionTree would grow on dense columns of the same features."""

    name = "Sparse Decision Tree"

    def __init__(self, max_depth: int = 2, criterion: str | Criterion = "entropy"):
        if max_depth < 1:
            raise ValueError("a tree needs a depth of at least 1")
        self._depth = max_depth
        self._criterion = CRITERIA[criterion] if isinstance(criterion, str) else criterion

    def info(self) -> dict[str, str]:
        return {"max depth": str(self._depth), "criterion": self._criterion.name}

    def _leaf(self, p: float, q: float) -> float:
        return float(np.clip((p - q) / (p + q), -1.0, 1.0)) if p + q > 0 else 0.0

    def _open(self, p: float, q: float) -> bool:
        return min(p, q) > 0

    def produce(self, train: Prepared, weight: Column) -> SparseTree:
        w = mass(weight)
        sums = [F.when(F.col(TARGET) > 0, w).otherwise(0.0), F.when(F.col(TARGET) > 0, 0.0).otherwise(w)]
        root, leaves = self._grow(train.df.filter(weight > 0), train, sums, self._depth, self._criterion)
        h = SparseTree(root)
        h.edge = sum((p - q) ** 2 / (p + q) for p, q in leaves if p + q > 0) / sum(p + q for p, q in leaves)
        return h


class SparseRegressionTree(_SparseLearner):
    """Trees on gradients and Hessians of a loss, the same as RegressionTree would grow on dense columns; a depth of d has d - 1 levels of splits.

    The gradients of the rows that lack a feature come by difference from the node's totals.
    """

    name = "Sparse Regression Tree"

    def __init__(self, loss: Loss | None = None, max_depth: int = 2, lambda_l2: float = 0.01):
        if max_depth < 1:
            raise ValueError("a tree needs a depth of at least 1")
        self.loss, self._depth, self._lambda = loss or L2(), max_depth, lambda_l2

    def info(self) -> dict[str, str]:
        return {"max depth": str(self._depth), "loss": self.loss.name, "lambda": str(self._lambda)}

    def _leaf(self, g: float, h: float) -> float:
        return -g / (h + self._lambda)

    def _open(self, g: float, h: float) -> bool:
        return g * g / (h + self._lambda) != 0.0

    def produce(self, train: Prepared, prediction: Column) -> SparseRegressor:
        y, least = F.col(TARGET), self._lambda
        sums = [mass(self.loss.gradient(prediction, y)).cast("double"), mass(self.loss.hessian(prediction, y)).cast("double")]
        gain = Criterion("gradient", lambda m, lp, lh, tp, th: -(lp * lp / (lh + least) + (tp - lp) * (tp - lp) / (th - lh + least)), lambda m, tp, th: 1e308)
        return SparseRegressor(self._grow(train.df, train, sums, self._depth - 1, gain)[0])
