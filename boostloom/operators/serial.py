"""Hypotheses from their JSON documents."""

from __future__ import annotations

import json


def from_dict(d: dict):
    from boostloom.operators.combined import NaiveAggregation, WeightedMajority
    from boostloom.operators.naive_bayes import GaussianClassifier
    from boostloom.operators.neural import Network, NetworkClassifier, NetworkRegressor
    from boostloom.operators.sparse import SparseRegressor, SparseTree, tree_of
    from boostloom.operators.trees import Node, TreeClassifier, TreeRegressor

    if d["kind"] == "weighted_majority":
        return WeightedMajority(d["weights"], [from_dict(h) for h in d["hypotheses"]])
    if d["kind"] == "gaussian_nb":
        return GaussianClassifier(d["classes"], d.get("soft", False))
    if d["kind"] in ("sparse_tree", "sparse_regressor"):
        return {"sparse_tree": SparseTree, "sparse_regressor": SparseRegressor}[d["kind"]](tree_of(d["root"]))
    if d["kind"] == "naive_aggregation":
        return NaiveAggregation.of([from_dict(h) for h in d["hypotheses"]], d["signatures"])
    if d["kind"].startswith("network_"):
        return {"network_classifier": NetworkClassifier, "network_regressor": NetworkRegressor}[d["kind"]](Network.from_dict(d["network"]), d["features"])
    return {"tree_classifier": TreeClassifier, "tree_regressor": TreeRegressor}[d["kind"]](Node.from_dict(d["root"]))


def from_json(text: str):
    return from_dict(json.loads(text))
