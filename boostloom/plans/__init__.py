"""Boosters: driver loops whose rounds are a few aggregates over a cached table."""

from boostloom.plans.additive import AdaBoost, AdaBoostV, MadaBoost, SmoothBoost
from boostloom.plans.base import Booster
from boostloom.plans.corrective import CERLPBoost, MLPBoost
from boostloom.plans.frank_wolfe import FrankWolfe
from boostloom.plans.gbm import GBM
from boostloom.plans.graph_separation import GraphSepBoost
from boostloom.plans.leveraging import ExpLev, SquareLevR
from boostloom.plans.research import CrossValidation, Logger, LoggerBuilder
from boostloom.plans.totally_corrective import ERLPBoost, LPBoost, SoftBoost, TotalBoost

__all__ = ["AdaBoost", "AdaBoostV", "Booster", "CERLPBoost", "CrossValidation", "ERLPBoost", "ExpLev", "FrankWolfe", "GBM", "GraphSepBoost", "LPBoost", "Logger", "LoggerBuilder", "MLPBoost", "MadaBoost", "SmoothBoost", "SoftBoost", "SquareLevR", "TotalBoost"]
