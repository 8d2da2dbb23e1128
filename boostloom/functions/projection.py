"""Projections of exponential weights onto the capped simplex, as a DataFrame plan and on groups."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def capped(log_weight: np.ndarray, number: np.ndarray, cap: float) -> np.ndarray:
    """Weights of one member of each group: min(cap, c exp(log_weight)) that add up to 1 over all members.

    The heaviest members are capped, as few as possible; the others share what is left in proportion.
    """
    order = np.argsort(-log_weight, kind="stable")
    l, n = log_weight[order] - log_weight.max(), number[order].astype(float)
    mass = n * np.exp(l)
    rest = np.cumsum(mass[::-1])[::-1]
    before = np.r_[0.0, np.cumsum(n)[:-1]]
    scale = (1.0 - cap * before) / np.maximum(rest, 1e-300)
    fits = scale * np.exp(l) <= cap * (1 + 1e-12)
    out = np.full(len(l), cap)
    if fits.any():
        i = int(np.argmax(fits))
        out[i:] = scale[i] * np.exp(l[i:])
    back = np.empty_like(out)
    back[order] = out
    return np.maximum(back, 0.0)


def capped_rows(rows: DataFrame, log_weight: Column, nu: float, name: str = "d", few: int = 10_000, bins: int = 512) -> DataFrame:
    """Add the projected weight of each row, with the cap 1 / nu.

    The heaviest weight that isn't capped is looked for as a quantile is: a histogram narrows the interval
    that it lies in until few rows are left there; each round is one aggregate, and nothing is sorted as a whole.
    """
    keyed = rows.withColumn("__l", log_weight)
    low, high = keyed.agg(F.min("__l"), F.max("__l")).first()
    top, before, under = high, 0.0, 0.0  # rows over the interval, mass under it
    fits = lambda l, before, rest: (1 - before / nu) * math.exp(l - top) <= rest / nu * (1 + 1e-12)
    found = None  # the largest weight so far that fits
    while low is not None:
        inside = keyed.filter((F.col("__l") >= low) & (F.col("__l") <= high))
        width = (high - low) / bins
        cell = F.least(F.floor((F.col("__l") - low) / width), F.lit(bins - 1)) if width and low + width > low else F.lit(0)
        mass = F.sum(F.exp(F.col("__l") - top))
        table = sorted(inside.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), mass.alias("mass"), F.min("__l").alias("a"), F.max("__l").alias("b")).collect(), reverse=True)
        last = len(table) == 1 or sum(r["n"] for r in table) <= few  # a few rows, or values as close as doubles can be
        if last:
            groups = sorted(inside.groupBy(F.col("__l").alias("b")).agg(F.count(F.lit(1)).alias("n"), mass.alias("mass")).collect(), reverse=True)
        over, rest = None, under + sum(r["mass"] for r in (groups if last else table))
        for r in groups if last else table:
            if fits(r["b"], before, rest):
                found = (r["b"], before, rest)
                break
            over, before, rest = (r, before), before + r["n"], rest - r["mass"]
        if last or over is None or over[0]["a"] == over[0]["b"]:
            break
        (r, before), under = over, rest  # one that is larger can only be in the last cell whose largest doesn't fit
        low, high = r["a"], r["b"]
    if found is None:
        return keyed.withColumn(name, F.lit(1.0 / nu)).drop("__l")
    l, before, rest = found
    scale = (1 - before / nu) / rest
    return keyed.withColumn(name, F.when(F.col("__l") > l, F.lit(1.0 / nu)).otherwise(F.lit(scale) * F.exp(F.col("__l") - top))).drop("__l")
