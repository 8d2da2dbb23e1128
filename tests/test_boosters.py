"""Boosters, solvers and the research harness."""

import math
import warnings
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from boostloom.functions.losses import L1, L2, HardMargin, SoftMargin
from boostloom.functions.projection import capped
from boostloom.operators import BadBaseLearner, DecisionTree, GaussianNB, RegressionTree
from boostloom.plans import GBM, AdaBoost, AdaBoostV, CERLPBoost, CrossValidation, ERLPBoost, FrankWolfe, GraphSepBoost, LoggerBuilder, LPBoost, MadaBoost, MLPBoost, SmoothBoost, SoftBoost, TotalBoost, solvers

from boostloom.plans.frank_wolfe import KINDS, interior_point
from boostloom.plans.programs import GroupPrograms
from boostloom.plans.research import format_unit, time_format
from boostloom.sources.sample import Sample


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 10, (1200, 3))
    y = np.where(x[:, 0] + x[:, 1] - x[:, 2] + rng.normal(0, 1.5, 1200) > 4.5, 1, -1)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return Sample.from_df(spark.createDataFrame(rows, "row_id long, f0 double, f1 double, f2 double, y double").repartition(3), ["f0", "f1", "f2"], "y", "row_id")


def arrays(sample, hypotheses):
    rows = sample.df.orderBy("row_id").select("y", *[h.confidence().alias(f"h{i}") for i, h in enumerate(hypotheses)]).toPandas().to_numpy()
    return rows[:, 0], rows[:, 1:]


def error(sample, f):
    return sample.df.filter(f.predict() != F.col("y")).count() / sample.shape()[0]


def test_adaboost_follows_its_update(sample):
    b = AdaBoost(sample).force_quit_at(9)  # over the rounds between two cuts
    b.run(DecisionTree(2))
    y, h = arrays(sample, b.hypotheses)
    d = np.full(len(y), 1 / len(y))
    for t in range(9):
        edge = (d * y * h[:, t]).sum()
        assert b.edges[t] == pytest.approx(edge) and b.weights[t] == pytest.approx(0.5 * math.log((1 + edge) / (1 - edge)))
        d = d * np.exp(-b.weights[t] * y * h[:, t])
        d /= d.sum()
    assert b.rounds == 9 and error(sample, b.current_hypothesis()) < 0.2


def test_adaboostv_and_madaboost(sample):
    v = AdaBoostV(sample).tolerance(0.05).force_quit_at(4)
    v.run(DecisionTree(1))
    for t, e in enumerate(v.edges):
        rho = min(v.edges[: t + 1]) - 0.05
        assert v.weights[t] == pytest.approx(math.atanh(e) - math.atanh(rho))
    m = MadaBoost(sample).force_quit_at(4)
    m.run(DecisionTree(1))
    y, h = arrays(sample, m.hypotheses)
    f = np.zeros(len(y))
    for t in range(4):
        d = np.minimum(1, np.exp(-y * f))
        assert m.edges[t] == pytest.approx((d * y * h[:, t]).sum() / d.sum())
        f += m.weights[t] * h[:, t]


def test_smoothboost(sample):
    b = SmoothBoost(sample).gamma(0.2).tolerance(0.05).force_quit_at(5)
    b.run(DecisionTree(1))
    y, h = arrays(sample, b.hypotheses)
    n = 1 + (y[:, None] * h).sum(1) - b.rounds * b.theta
    want = np.where(n <= 0, 1.0, 0.8 ** (n / 2)).sum()
    assert b.train.df.agg(F.sum(F.col("n") * b.measure())).first()[0] == pytest.approx(want)
    assert b.weights == [1 / b.rounds] * b.rounds
    with pytest.raises(ValueError):
        SmoothBoost(sample).gamma(0.5)
    with pytest.raises(ValueError):
        SmoothBoost(sample).run(DecisionTree(1))


def test_a_perfect_hypothesis_ends_the_run(spark):
    s = Sample.from_df(spark.range(20).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") < 9, -1.0).otherwise(1.0).alias("y")), ["x"], "y")
    for b in (AdaBoost(s), AdaBoostV(s), MadaBoost(s)):
        f = b.run(DecisionTree(1))
        assert f.weights == [1.0] and error(s, f) == 0


def test_boosting_other_learners(sample):
    f = AdaBoost(sample).force_quit_at(3).run(GaussianNB())
    assert error(sample, f) < 0.25


@pytest.mark.parametrize("loss", [L1(), L2()])
def test_gbm(spark, loss):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, (600, 2))
    y = np.round(3.0 * x[:, 0] - x[:, 1] ** 2 + rng.normal(0, 0.5, 600), 2)
    s = Sample.from_df(spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double"), ["a", "b"], "y")
    b = GBM.init_with_loss(s, loss).max_iter(8)
    f = b.run(RegressionTree(L2(), 3))
    track = [s.df.agg(loss.mean(type(f)(f.weights[:t], f.hypotheses[:t]).predict())).first()[0] for t in range(1, 9)]
    assert all(a >= b - 1e-9 for a, b in zip(track, track[1:])) and track[-1] < track[0] / 2
    p = s.df.select(f.predict().alias("p"), type(f).from_json(f.to_json()).predict().alias("q")).toPandas()
    assert np.allclose(p["p"], p["q"])


def test_graph_separation(sample):
    b = GraphSepBoost(sample)
    learner = DecisionTree(2, "edge")
    b.preprocess(learner)
    for t in range(1, 4):
        b.boost(learner, t)
    y, h = arrays(sample, b.hypotheses)
    for t in range(3):
        signature = (h[:, :t] >= 0) @ (1 << np.arange(t)) if t else np.zeros(len(y), int)
        joined = (y[:, None] != y[None]) & (signature[:, None] == signature[None])
        assert b.edges_left[t] == joined.sum() // 2
    f = b.current_hypothesis()
    known = {tuple(r) for r, v in zip(h >= 0, y) if v > 0}
    got = [r["prediction"] for r in f.predict_all(sample).orderBy("row_id").collect()]
    assert got == [1 if tuple(r) in known else -1 for r in h >= 0]


def test_graph_separation_without_progress_warns(spark):
    s = Sample.from_df(spark.createDataFrame([(0.0, 1.0), (0.0, -1.0)], "x double, y double"), ["x"], "y")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        GraphSepBoost(s).run(DecisionTree(1))
    assert any("separated no rows" in str(w.message) for w in seen)


def problem(seed, groups=60, t=6):
    rng = np.random.default_rng(seed)
    return np.clip(rng.normal(0.15, 0.6, (groups, t)), -1, 1), rng.integers(1, 6, groups).astype(float)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("share", [0.02, 0.2, 0.7])
def test_linear_program(seed, share):
    a, n = problem(seed)
    nu = max(1.0, share * n.sum())
    value, w, d = solvers.soft_margin_lp(a, n, nu)
    assert w.sum() == pytest.approx(1) and (w >= 0).all() and (n * d).sum() == pytest.approx(1) and d.max() <= 1 / nu + 1e-7
    order = np.argsort(a @ w)
    left, primal = 1.0, 0.0
    for i in order:
        take = min(left, n[i] / nu)
        primal, left = primal + take * (a @ w)[i], left - take
    dual = (a.T @ (n * d)).max()
    assert primal == pytest.approx(value, abs=1e-6) and dual == pytest.approx(value, abs=1e-6)


@pytest.mark.parametrize("seed", range(3))
def test_entropy_programs(seed):
    a, n = problem(seed)
    nu, eta = 0.1 * n.sum(), 40.0
    value, w, d = solvers.entropy_program(a, n, nu, eta)
    primal = (a.T @ (n * d)).max() + solvers.divergence(d, n) / eta
    assert (n * d).sum() == pytest.approx(1) and d.max() <= 1 / nu + 1e-9 and primal - value < 1e-4
    bound = solvers.soft_margin_lp(a, n, nu)[0] + 0.02
    d = solvers.least_divergence(a, n, nu, bound)
    assert (a.T @ (n * d)).max() <= bound + 1e-4 and (n * d).sum() == pytest.approx(1)
    assert solvers.least_divergence(a, n, nu, bound - 0.05) is None
    loose = solvers.least_divergence(a, n, nu, 2.0)
    assert np.allclose(loose, 1 / n.sum())


def test_simplex_projection():
    v = np.array([0.9, 0.6, -1.0])
    p = solvers.simplex(v)
    assert p.sum() == pytest.approx(1) and np.allclose(p, [0.65, 0.35, 0])


def groups_of(a, n):
    """Programs over given groups."""
    out = GroupPrograms.__new__(GroupPrograms)
    out.groups = SimpleNamespace(margins=a, number=n)
    return out


@pytest.mark.parametrize("kind", KINDS)
def test_frank_wolfe_climbs(kind):
    a, n = problem(1)
    nu, eta = 0.1 * n.sum(), 30.0
    programs = groups_of(a, n)
    value = lambda w: programs.smooth(w, nu, eta)
    best, _, _ = solvers.entropy_program(a, n, nu, eta)
    fw, w, track = FrankWolfe(eta, kind), np.zeros(a.shape[1]), []
    for t in range(1, 150):
        programs.smooth(w, nu, eta)
        w = fw.next(w, int(programs.edges.argmax()), t, programs, nu)
        assert w.sum() == pytest.approx(1) and (w >= -1e-12).all()
        track.append(value(w))
    assert best - track[-1] < (0.06 if kind == "short_step" else 0.02)
    if kind != "classic":
        assert all(y >= x - 1e-9 for x, y in zip(track, track[1:]))
    with pytest.raises(ValueError):
        interior_point(w, w, 1.5)


@pytest.mark.parametrize("make", [lambda s, m: LPBoost(s).nu(0.1 * m).tolerance(0.02), lambda s, m: ERLPBoost(s).nu(0.1 * m).tolerance(0.1), lambda s, m: SoftBoost(s).nu(0.1 * m).tolerance(0.05).force_quit_at(8), lambda s, m: TotalBoost(s).tolerance(0.05).force_quit_at(6), lambda s, m: CERLPBoost(s).nu(0.1 * m).tolerance(0.2).force_quit_at(10), lambda s, m: MLPBoost(s).nu(0.1 * m).tolerance(0.1).force_quit_at(10)])
def test_margin_boosters(sample, make):
    m = sample.shape()[0]
    b = make(sample, m)
    f = b.run(DecisionTree(2))
    assert sum(f.weights) == pytest.approx(1) and error(sample, f) < 0.3 and b.terminated()
    d, n = b.d, b.groups.number[: len(b.d)]
    assert n.sum() == m
    if len(d) == len(b.groups.number):
        assert (b.groups.number * d).sum() == pytest.approx(1, abs=1e-6) and d.max() <= 1 / b._nu + 1e-6
    y, h = arrays(sample, b.groups.hypotheses)
    found = {tuple(np.round(r, 9)) for r in b.groups.margins}
    assert {tuple(np.round(r, 9)) for r in y[:, None] * h} == found
    if isinstance(b, LPBoost):
        assert SoftMargin(0.1 * m).eval(sample, f) == pytest.approx(b.value, abs=1e-5)


def test_total_boost_is_soft_boost_without_a_cap(sample):
    a = TotalBoost(sample).tolerance(0.05).force_quit_at(3)
    b = SoftBoost(sample).nu(1).tolerance(0.05).force_quit_at(3)
    a.run(DecisionTree(1))
    b.run(DecisionTree(1))
    assert [r["edge"] for r in a.trace] == pytest.approx([r["edge"] for r in b.trace])
    with pytest.raises(AttributeError):
        TotalBoost(sample).nu(3)


def test_lpboost_on_the_bad_learner(spark):
    learner = BadBaseLearner(1e-3, 1.0)
    b = LPBoost(Sample.dummy(spark, 24)).tolerance(1e-6).nu(1.0)
    b.run(learner)
    values = [r["value"] for r in b.trace]
    assert b.rounds > 4 and all(y >= x - 1e-7 for x, y in zip(values, values[1:]))
    assert learner.edges(b.train, b.weight)["edge"].max() <= b.value + 1e-6


def test_nu_is_checked(sample):
    for nu in (0.5, sample.shape()[0] + 1):
        with pytest.raises(ValueError):
            LPBoost(sample).nu(nu).run(DecisionTree(1))


def test_logger(sample, tmp_path, capsys):
    train, test = sample.split(0, 300)
    path = tmp_path / "log.csv"
    logger = (
        LoggerBuilder().booster(AdaBoost(train).force_quit_at(4)).weak_learner(DecisionTree(1)).objective_function(SoftMargin(20))
        .train_sample(train).test_sample(test).time_limit_as_secs(600).print_every(2).build()
    )
    f = logger.run(str(path))
    lines = path.read_text().splitlines()
    assert lines[0] == "ObjectiveValue,TrainLoss,TestLoss,Time" and len(lines) == 5
    last = list(map(float, lines[-1].split(",")))
    assert last[1] == pytest.approx(error(train, f)) and last[2] == pytest.approx(error(test, f)) and last[0] == pytest.approx(SoftMargin(20).eval(train, f))
    assert logger.frame().count() == 4 and "[LOG]" in capsys.readouterr().out
    with pytest.raises(ValueError):
        LoggerBuilder().build()


def test_logger_stops_in_time(sample, capsys):
    logger = LoggerBuilder().booster(AdaBoost(sample).force_quit_at(50)).weak_learner(DecisionTree(1)).objective_function(HardMargin()).train_sample(sample).test_sample(sample).time_limit_as_millis(1).build()
    logger.run()
    assert len(logger.records) == 1 and "[TLE]" in capsys.readouterr().out


def test_cross_validation(sample):
    seen = []
    for train, test in CrossValidation(sample).n_folds(4).train_ratio(0.75).shuffle().seed(7):
        ids = {r["row_id"] for r in test.df.collect()}
        assert len(ids) == 300 and train.df.count() == 900 and not ids & {r["row_id"] for r in train.df.collect()}
        seen.append(ids)
    assert set().union(*seen) == set(range(1200))
    plain = [sorted(r["row_id"] for r in test.df.collect()) for _, test in CrossValidation(sample)]
    assert plain[1] == list(range(240, 480)) and len(plain) == 5
    with pytest.raises(ValueError):
        list(CrossValidation(sample).n_folds(20).train_ratio(0.5))


def test_formats():
    assert format_unit(1500) == "1.500 K" and format_unit(2e9) == "2.000 G" and time_format(61_005).startswith("1 m 01 s")
