"""Decision and regression trees, grown level by level: one aggregate for all nodes and features of a level."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostloom.functions.losses import L2, Loss
from boostloom.operators import binning
from boostloom.operators.base import Classifier, Prepared, Regressor, WeakLearner, mass
from boostloom.operators.binning import Bins, bin_column
from boostloom.operators.criteria import ARRAYS, CRITERIA, Criterion, best_cut
from boostloom.sources.sample import TARGET, Sample


@dataclass(eq=False)
class Node:
    """A leaf has a value; a branch sends `feature < threshold` (bin <= `bin`) to the left."""

    value: float = 0.0
    feature: str | None = None
    threshold: float = 0.0
    bin: int = 0
    left: Node | None = None
    right: Node | None = None

    def column(self, binned: bool) -> Column:
        if self.feature is None:
            return F.lit(float(self.value))
        test = F.col(bin_column(self.feature)) <= self.bin if binned else F.col(f"`{self.feature}`") < self.threshold
        return F.when(test, self.left.column(binned)).otherwise(self.right.column(binned))

    def to_dict(self) -> dict:
        if self.feature is None:
            return {"value": self.value}
        return {"feature": self.feature, "threshold": self.threshold, "bin": self.bin, "left": self.left.to_dict(), "right": self.right.to_dict()}

    @staticmethod
    def from_dict(d: dict) -> Node:
        if "feature" not in d:
            return Node(d["value"])
        return Node(0.0, d["feature"], d["threshold"], d["bin"], Node.from_dict(d["left"]), Node.from_dict(d["right"]))

    def __eq__(self, other) -> bool:
        return isinstance(other, Node) and self.to_dict() == other.to_dict()

    __hash__ = None

    def leaves(self) -> list[float]:
        return [self.value] if self.feature is None else self.left.leaves() + self.right.leaves()

    def dot(self, lines: list[str]) -> int:
        """Statements for this node and all below, numbered in preorder; returns its number."""
        me = sum(1 for x in lines if "[label" in x and "->" not in x)
        if self.feature is None:
            lines.append(f'    n{me} [label = "{self.value:.4f}", shape = box];')
            return me
        lines.append(f'    n{me} [label = "{self.feature} < {self.threshold:.4f} ?"];')
        for child, word in ((self.left, "Yes"), (self.right, "No")):
            lines.append(f'    n{me} -> n{child.dot(lines)} [label = "{word}"];')
        return me

    def text(self, indent: str = "") -> str:
        if self.feature is None:
            return f"{indent}{self.value:+.6g}\n"
        return f"{indent}{self.feature} < {self.threshold:.6g} ?\n{self.left.text(indent + '  ')}{self.right.text(indent + '  ')}"


class _Tree:
    kind = ""

    def __init__(self, root: Node):
        self.root = root

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "root": self.root.to_dict()})

    def to_dot(self) -> str:
        lines = ["digraph tree {"]
        self.root.dot(lines)
        return "\n".join([*lines, "}"]) + "\n"

    def to_dot_file(self, path: str) -> None:
        with open(path, "w") as f:
            f.write(self.to_dot())

    def __str__(self) -> str:
        return self.root.text()

    def __eq__(self, other) -> bool:
        return type(self) is type(other) and self.root == other.root

    def __hash__(self) -> int:
        return hash(self.to_json())


class TreeClassifier(_Tree, Classifier):
    kind = "tree_classifier"

    def confidence(self, binned: bool = False) -> Column:
        return self.root.column(binned)


class TreeRegressor(_Tree, Regressor):
    kind = "tree_regressor"

    def predict(self, binned: bool = False) -> Column:
        return self.root.column(binned)


def histogram(train: DataFrame, features: list[str], node: Column, sums: list[Column]) -> DataFrame:
    """(node, feature, bin) and sums, of rows that are in a node: one exchange, after partial sums on the map side."""
    pairs = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(bin_column(f)).alias("bin")) for i, f in enumerate(features)])
    rows = train.withColumn("__node", node).filter(F.col("__node") >= 0)
    flat = rows.select(F.col("__node").alias("node"), *sums, F.explode(pairs).alias("p"))
    names = [c for c in flat.columns if c not in ("node", "p")]
    return flat.select("node", "p.feature", "p.bin", *names).groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in names], F.count(F.lit(1)).alias("rows"))


def _places(root: Node, open_nodes: dict[int, int]) -> Column:
    """The number of the open node that a row is in, or -1."""

    def walk(node: Node) -> Column:
        if node.feature is None:
            return F.lit(open_nodes.get(id(node), -1))
        return F.when(F.col(bin_column(node.feature)) <= node.bin, walk(node.left)).otherwise(walk(node.right))

    return walk(root)


class _TreeLearner(WeakLearner):
    def __init__(self, max_depth: int):
        if max_depth < 1:
            raise ValueError("a tree needs a depth of at least 1")
        self._depth = max_depth
        self._n_bins: dict[str, int] = {}

    def max_depth(self, depth: int):
        if depth < 1:
            raise ValueError("a tree needs a depth of at least 1")
        self._depth = depth
        return self

    def set_nbins(self, feature: str, n: int):
        self._n_bins[feature] = n
        return self

    def build(self):
        return self

    def _grow(self, train: Prepared, sums: list[Column], levels: int, keep: Column | None) -> Node:
        """Split open nodes level by level; `_leaf` and `_split` judge a node's sums by feature and bin."""
        bins: dict[str, Bins] = train.extra["bins"]
        features = list(bins)
        df = train.df if keep is None else train.df.filter(keep)
        root = Node()
        frontier = [root]
        for level in range(levels + 1):
            if not frontier:
                break
            last = level == levels
            at = {id(n): i for i, n in enumerate(frontier)}
            # a level's leaves need the totals only, which any one feature gives
            table = histogram(df, features[:1] if last and level else features, _places(root, at), sums).toPandas()
            if not len(table) and level == 0:
                raise ValueError("no row has a positive weight")
            following = []
            by_node = dict(tuple(table.groupby("node", sort=True)))
            for i, node in enumerate(frontier):
                if i not in by_node:
                    continue
                mine = {f: g.sort_values("bin") for f, g in by_node[i].groupby("feature", sort=True)}
                if not self._leaf(node, mine[0]) and not last:
                    best = None
                    for f, g in mine.items():
                        if len(g) > 1 and (found := self._split(g)) is not None:
                            key = (found[0], f, found[1])
                            best = min(best, key) if best else key
                    if best:
                        _, f, cut = best
                        cells = mine[f]["bin"].to_numpy()
                        name = features[f]
                        node.feature, node.bin = name, int(cells[cut])
                        node.threshold = bins[name].threshold(int(cells[cut]), int(cells[cut + 1]))
                        node.left, node.right = Node(), Node()
                        following += [node.left, node.right]
            if last or not following:
                break
            if level + 1 == levels:  # the children's totals are known from this level's table
                self._close(by_node, frontier, features)
                break
            frontier = following
        return root

    def _close(self, by_node: dict, frontier: list[Node], features: list[str]) -> None:
        """Values of the last level's children, from their parents' histograms."""
        for i, node in enumerate(frontier):
            if node.feature is None:
                continue
            g = by_node[i]
            g = g[g["feature"] == features.index(node.feature)]
            self._leaf(node.left, g[g["bin"] <= node.bin])
            self._leaf(node.right, g[g["bin"] > node.bin])

    def _leaf(self, node: Node, table) -> bool:
        """Set the value of a node from its sums; true if it needs no split."""
        raise NotImplementedError

    def _split(self, table) -> tuple[float, int] | None:
        """(score, position of the last bin on the left)."""
        raise NotImplementedError


class DecisionTree(_TreeLearner):
    """Confidence-rated classification trees of `max_depth` levels of splits."""

    name = "Decision Tree"

    def __init__(self, max_depth: int = 2, criterion: str | Criterion = "entropy", prune: bool = False):
        super().__init__(max_depth)
        self._criterion = CRITERIA[criterion] if isinstance(criterion, str) else criterion
        self._prune = prune

    def criterion(self, criterion: str | Criterion):
        self._criterion = CRITERIA[criterion] if isinstance(criterion, str) else criterion
        return self

    def info(self) -> dict[str, str]:
        return {"max depth": str(self._depth), "criterion": self._criterion.name}

    def prepare(self, sample: Sample, keep_rows: bool = False) -> Prepared:
        return binning.prepare(sample, self._n_bins, keep_rows)

    def produce(self, train: Prepared, weight: Column) -> TreeClassifier:
        w = mass(weight)
        sums = [F.when(F.col(TARGET) > 0, w).otherwise(0.0).alias("positive"), F.when(F.col(TARGET) > 0, 0.0).otherwise(w).alias("negative")]
        self._masses: dict[int, tuple[float, float]] = {}
        root = self._grow(train, sums, self._depth, weight > 0)
        if self._prune:
            self._collapse(root)
        h = TreeClassifier(root)
        leaves = [self._masses[id(n)] for n in _leaf_nodes(root)]
        total = sum(p + q for p, q in leaves)
        h.edge = float(sum((p - q) * n.value for (p, q), n in zip(leaves, _leaf_nodes(root), strict=True)) / total)
        return h

    def _leaf(self, node: Node, table) -> bool:
        p, q = float(table["positive"].sum()), float(table["negative"].sum())
        node.value = float(np.clip((p - q) / (p + q), -1.0, 1.0)) if p + q > 0 else 0.0
        self._masses[id(node)] = (p, q)
        return min(p, q) == 0.0

    def _split(self, table) -> tuple[float, int] | None:
        p, q = table["positive"].to_numpy(float), table["negative"].to_numpy(float)
        score, cut = best_cut(self._criterion, p, q)
        return (score, cut) if score < self._criterion.parent(ARRAYS, p.sum(), q.sum()) else None

    def _collapse(self, node: Node) -> None:
        """Bottom up, make a branch a leaf if its children err no less than it would."""
        if node.feature is None:
            return
        self._collapse(node.left)
        self._collapse(node.right)
        p, q = self._masses[id(node)]
        if min(p, q) <= sum(min(self._masses[id(n)]) for n in _leaf_nodes(node)) + 1e-12:
            node.feature = node.left = node.right = None


def _leaf_nodes(node: Node) -> list[Node]:
    return [node] if node.feature is None else _leaf_nodes(node.left) + _leaf_nodes(node.right)


class RegressionTree(_TreeLearner):
    """Trees on gradients and Hessians of a loss; a depth of d has d - 1 levels of splits."""

    name = "Regression Tree"

    def __init__(self, loss: Loss | None = None, max_depth: int = 2, lambda_l2: float = 0.01):
        super().__init__(max_depth)
        self.loss, self._lambda = loss or L2(), lambda_l2

    def lambda_l2(self, value: float):
        self._lambda = value
        return self

    def info(self) -> dict[str, str]:
        return {"max depth": str(self._depth), "loss": self.loss.name, "lambda": str(self._lambda)}

    def prepare(self, sample: Sample, keep_rows: bool = False) -> Prepared:
        return binning.prepare(sample, self._n_bins, keep_rows)

    def produce(self, train: Prepared, prediction: Column) -> TreeRegressor:
        y = F.col(TARGET)
        sums = [mass(self.loss.gradient(prediction, y)).cast("double").alias("g"), mass(self.loss.hessian(prediction, y)).cast("double").alias("h")]
        return TreeRegressor(self._grow(train, sums, self._depth - 1, None))

    def _leaf(self, node: Node, table) -> bool:
        g, h = float(table["g"].sum()), float(table["h"].sum())
        node.value = -g / (h + self._lambda)
        return g * g / (h + self._lambda) == 0.0

    def _split(self, table) -> tuple[float, int] | None:
        g, h = np.cumsum(table["g"].to_numpy(float)), np.cumsum(table["h"].to_numpy(float))
        left, right = g[:-1] ** 2 / (h[:-1] + self._lambda), (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + self._lambda)
        score = -np.round(left + right, 8)
        at = int(np.argmin(score))
        return float(score[at]), at
