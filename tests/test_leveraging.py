"""Leveraging for regression against its definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boostloom.functions.losses import L2
from boostloom.operators import DecisionTree, RegressionTree
from boostloom.plans import ExpLev, SquareLevR
from boostloom.sources.sample import Sample


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 4, (500, 2)).round(2)
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1] + rng.normal(0, 0.1, 500) - 0.7
    rows = [(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))]
    return Sample.from_df(spark.createDataFrame(rows, "row_id long, a double, b double, y double"), ["a", "b"], "y", "row_id")


def columns(s, *cs):
    return s.df.orderBy("row_id").select("y", *cs).toPandas().to_numpy(float).T


def test_square_lev_lowers_the_variance_by_the_correlation(data):
    b = SquareLevR(data).max_iter(4).tolerance(1e-6)
    f = b.run(RegressionTree(L2(), 3))
    y, *hs = columns(data, *[h.predict() for h in b.hypotheses])
    r = y.copy()
    for record, h, w in zip(b.trace, hs, b.weights, strict=True):
        assert record["potential"] == pytest.approx(r.var()) and record["correlation"] == pytest.approx(np.corrcoef(r, h)[0, 1])
        assert w == pytest.approx(np.cov(r, h, bias=True)[0, 1] / h.var())
        before, r = r.var(), r - w * h
        assert r.var() == pytest.approx(before * (1 - record["correlation"] ** 2))
    _, shown = columns(data, f.predict())
    assert y - shown == pytest.approx(r - r.mean(), abs=1e-9)
    assert (y - shown).var() < 0.2 * y.var()


def test_exp_lev_lowers_its_potential_each_round(data):
    b = ExpLev(data).softness(2.0).max_iter(5)
    f = b.run(DecisionTree(2))
    y, *hs = columns(data, *[h.confidence() for h in b.hypotheses])
    r, track = y.copy(), []
    for record, h, w in zip(b.trace, hs, b.weights, strict=True):
        d = np.abs(np.exp(2 * r) - np.exp(-2 * r))
        track.append(np.log((np.exp(2 * r) + np.exp(-2 * r) - 2).sum()))
        edge = (d * np.sign(r) * h).sum() / d.sum()
        assert record["potential"] == pytest.approx(track[-1]) and record["correlation"] == pytest.approx(min(edge, 0.99), abs=1e-9)
        assert w == pytest.approx(np.log((1 + edge) / (1 - edge)) / 4)
        r = r - w * h
    assert all(b < a for a, b in zip(track, track[1:])) and len(track) == 5
    _, shown = columns(data, f.predict())
    assert y - shown == pytest.approx(r, abs=1e-9)


def test_leveraging_ends(spark, data):
    assert SquareLevR(data).tolerance(1e9).run(DecisionTree(1)).weights == []
    assert ExpLev(data).tolerance(1e9).softness(1.0).run(DecisionTree(1)).weights == []
    flat = Sample.from_df(data.df.select(F.lit(1.0).alias("a"), "y"), ["a"], "y")
    f = SquareLevR(flat).run(RegressionTree(L2(), 2))
    assert f.weights == [] and f.constant == pytest.approx(columns(data)[0].mean())
    b = ExpLev(data).tolerance(0.5).max_iter(3)
    b.run(DecisionTree(1))
    assert b.s == pytest.approx(np.log(500) / 0.5)
