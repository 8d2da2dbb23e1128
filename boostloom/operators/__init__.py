"""Hypotheses and weak learners."""

from boostloom.operators.bad_learner import BadBaseLearner
from boostloom.operators.base import Classifier, Regressor, WeakLearner
from boostloom.operators.combined import NaiveAggregation, WeightedMajority
from boostloom.operators.external import ExternalClassifier, ExternalLearner
from boostloom.operators.naive_bayes import GaussianNB
from boostloom.operators.neural import NeuralNetwork
from boostloom.operators.sparse import SparseDecisionTree, SparseRegressionTree
from boostloom.operators.sparse_bayes import SparseGaussianNB
from boostloom.operators.trees import DecisionTree, RegressionTree
from boostloom.operators.union import LearnerUnion

__all__ = ["BadBaseLearner", "Classifier", "DecisionTree", "ExternalClassifier", "ExternalLearner", "GaussianNB", "LearnerUnion", "NaiveAggregation", "NeuralNetwork", "RegressionTree", "Regressor", "SparseDecisionTree", "SparseGaussianNB", "SparseRegressionTree", "WeakLearner", "WeightedMajority"]
