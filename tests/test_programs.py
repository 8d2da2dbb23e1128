"""Programs over rows against those over groups, and boosters that use them."""

from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from boostloom.functions.losses import SoftMargin
from boostloom.functions.projection import capped
from boostloom.operators import DecisionTree, GaussianNB
from boostloom.operators.base import Prepared
from boostloom.plans import CERLPBoost, ERLPBoost, LPBoost, MLPBoost, SoftBoost, TotalBoost, solvers
from boostloom.plans.corrective import double_log_noise
from boostloom.plans.programs import CellDual, Dual, GroupPrograms, RowPrograms, best_quadratic
from boostloom.sources.sample import Sample

ETA = 40.0


def problem(seed, groups=80, t=5):
    rng = np.random.default_rng(seed)
    return np.clip(rng.normal(0.15, 0.6, (groups, t)), -1, 1), rng.integers(1, 6, groups).astype(float)


def by_rows(spark, a, n, parts=3):
    rows = [(1.0, float(k), *map(float, r)) for r, k in zip(a, n, strict=True)]
    df = spark.createDataFrame(rows, "y double, n double, " + ", ".join(f"__m{j} double" for j in range(a.shape[1]))).repartition(parts).persist()
    out = RowPrograms(Prepared(df, int(n.sum())))
    out.hypotheses = [None] * a.shape[1]
    return out


def by_groups(a, n):
    out = GroupPrograms.__new__(GroupPrograms)
    out.groups = SimpleNamespace(margins=a, number=n)
    return out


def shares(programs, a, n):
    """(d, edges) of the weight column, read back from the rows."""
    w = programs.weight()
    rows = programs.train.df.select("n", w.alias("d"), *[f"__m{j}" for j in range(a.shape[1])]).toPandas().to_numpy()
    assert rows[:, 1].min() >= 0 and (rows[:, 0] * rows[:, 1]).sum() == pytest.approx(1, abs=1e-6)
    return rows[:, 1], rows[:, 2:].T @ (rows[:, 0] * rows[:, 1])


@pytest.mark.parametrize(("seed", "share"), [(1, 0.7), (2, 0.1)])
def test_the_linear_program_over_rows(spark, seed, share):
    a, n = problem(seed)
    nu = share * n.sum()
    best, _, _ = solvers.soft_margin_lp(a, n, nu)
    rows = by_rows(spark, a, n)
    value, w = rows.soft_margin(nu, 1e-3)
    assert best - 1e-9 <= value <= best + 1e-3 and w.sum() == pytest.approx(1) and (w >= 0).all()
    d, edges = shares(rows, a, n)
    assert d.max() <= 1 / nu + 1e-9 and edges.max() == pytest.approx(value, abs=1e-6)
    order = np.argsort(a @ w)
    left, primal = 1.0, 0.0
    for i in order:
        take = min(left, n[i] / nu)
        primal, left = primal + take * (a @ w)[i], left - take
    assert value - primal <= 1e-3 + 1e-6, "the soft margin of the weights bounds the edges from below"


def test_the_linear_program_takes_few_aggregates(spark, monkeypatch):
    a, n = problem(7, 400, 3)
    nu = 0.1 * n.sum()
    best, looks, look = solvers.soft_margin_lp(a, n, nu)[0], [], Dual.look
    monkeypatch.setattr(Dual, "look", lambda self, *args: looks.append(self.eta) or look(self, *args))
    value, w = by_rows(spark, a, n).soft_margin(nu, 5e-3)
    assert best - 1e-9 <= value <= best + 5e-3 and w.sum() == pytest.approx(1)
    assert len(looks) <= 12
    monkeypatch.setattr(CellDual, "MOST", 1)  # without cells to start from
    value, _ = by_rows(spark, a, n).soft_margin(nu, 5e-3)
    assert best - 1e-9 <= value <= best + 5e-3


def test_rounding_does_not_keep_a_step_from_its_whole_length():
    class Rough(CellDual):
        """Sums over very many rows: shorter steps look better by a rounding error."""

        def look(self, v, theta, working, near=()):
            out = super().look(v, theta, working, near)
            out.shorter = [x + 1e-14 for x in out.shorter]
            return out

    a, n = problem(8, 400, 2)
    rough = Rough(np.column_stack([n, 0 * n, a]), 40.0, 0.1 * n.sum(), n.sum())
    even = lambda v, look: abs(1 - look.total) < 1e-10
    v, theta, look = rough.ascend(np.array([0.5, 0.5]), 0.0, even)
    assert even(v, look) and rough.looks <= 12


def test_entropy_programs_over_rows(spark):
    a, n = problem(3)
    nu = 0.1 * n.sum()
    rows, groups = by_rows(spark, a, n), by_groups(a, n)
    x, y = rows.entropy(nu, ETA, None), groups.entropy(nu, ETA, None)
    assert x[0] == pytest.approx(y[0], abs=1e-6) and x[1] == pytest.approx(y[1], abs=1e-4)
    d, edges = shares(rows, a, n)
    assert edges == pytest.approx(rows.edges, abs=1e-7) and sorted(d) == pytest.approx(sorted(groups.d), abs=1e-5)
    bound = solvers.soft_margin_lp(a, n, nu)[0] + 0.03
    assert rows.least_divergence(nu, bound) and groups.least_divergence(nu, bound)
    assert rows.edges.max() <= bound + 1e-5 and rows.divergence == pytest.approx(groups.divergence, abs=1e-5)
    shares(rows, a, n)
    assert not rows.least_divergence(nu, bound - 0.06)
    assert rows.least_divergence(nu, 2.0) and rows.divergence == pytest.approx(0, abs=1e-9)


def test_smoothed_margins_and_searches_over_rows(spark):
    a, n = problem(4)
    nu = 0.2 * n.sum()
    rows, groups = by_rows(spark, a, n), by_groups(a, n)
    w = np.array([0.3, 0.0, 0.5, 0.2, 0.0])
    assert rows.smooth(w, nu, ETA) == pytest.approx(groups.smooth(w, nu, ETA), abs=1e-9)
    assert rows.edges == pytest.approx(groups.edges, abs=1e-8) and rows.divergence == pytest.approx(groups.divergence, abs=1e-7)
    assert sorted(shares(rows, a, n)[0]) == pytest.approx(sorted(capped(-ETA * (a @ w), n, 1 / nu)), abs=1e-9)
    for direction, most in [(np.eye(5)[1] - w, 1.0), (np.array([-0.1, 0, 0.1, 0, 0]), 3.0), (np.array([0, 0, 0, 0, 0.0]), 1.0)]:
        assert rows.widest(direction) == pytest.approx(groups.widest(direction))
        if direction.any():
            assert rows.search(w, direction, most, nu, ETA) == pytest.approx(groups.search(w, direction, most, nu, ETA), abs=1e-4)


def test_quadratic_programs():
    rng = np.random.default_rng(0)
    for _ in range(20):
        t = 5
        b = rng.normal(size=(t, t))
        curve, ascent, v = b @ b.T, rng.normal(size=t), rng.dirichlet(np.ones(t))
        for domain in ("simplex", "nonnegative"):
            x = best_quadratic(curve, ascent, v, domain)
            slope = ascent - curve @ (x - v)
            level = slope @ x if domain == "simplex" else 0.0
            assert (x >= 0).all() and slope.max() <= level + 1e-6 and np.abs((slope - level) * x).max() < 1e-6
    assert best_quadratic(np.array([[2.0]]), np.array([10.0]), np.array([0.2]), 0.9) == pytest.approx([0.9])


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (600, 2))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.7, 600) > 0.4, 1, -1)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return Sample.from_df(spark.createDataFrame(rows, "row_id long, f0 double, f1 double, y double").repartition(3), ["f0", "f1"], "y", "row_id")


MAKERS = {
    "lp": lambda s: LPBoost(s).nu(60).tolerance(0.02).force_quit_at(3),
    "erlp": lambda s: ERLPBoost(s).nu(60).tolerance(0.2).force_quit_at(3),
    "soft": lambda s: SoftBoost(s).nu(60).tolerance(0.1).force_quit_at(2),
    "pairwise": lambda s: CERLPBoost(s).nu(60).tolerance(0.2).fw_type("blended_pairwise").force_quit_at(3),
    "short": lambda s: CERLPBoost(s).nu(60).tolerance(0.2).force_quit_at(2),
    "mlp": lambda s: MLPBoost(s).nu(60).tolerance(0.2).force_quit_at(2),
}


@pytest.mark.parametrize("kind", ["erlp", "soft", "pairwise", "short", "mlp"])
def test_boosters_over_rows_go_as_over_groups(sample, kind):
    a, b = MAKERS[kind](sample), MAKERS[kind](sample).over_rows()
    f, g = a.run(DecisionTree(1)), b.run(DecisionTree(1))
    assert b.programs.over_rows and not a.programs.over_rows
    assert [r["edge"] for r in a.trace] == pytest.approx([r["edge"] for r in b.trace], abs=1e-4)
    # the linear program's weights, which mlp may take, are unique up to its gap only
    assert [r["value"] for r in a.trace] == pytest.approx([r["value"] for r in b.trace], abs=0.05 if kind == "mlp" else 2e-3)
    if kind not in ("soft", "mlp"):
        assert f.weights == pytest.approx(g.weights, abs=2e-2)


def test_erlpboost_goes_on_where_the_first_round_is_close_enough(spark, sample):
    short = ERLPBoost(sample).nu(60).tolerance(1.9).force_quit_at(2).over_rows()
    short.run(DecisionTree(1))
    both = ERLPBoost(sample).nu(60).tolerance(1.9).at_least(2).force_quit_at(2).over_rows()
    both.run(DecisionTree(1))
    assert [r["round"] for r in short.trace] == [1] and [r["round"] for r in both.trace] == [1, 2]
    assert both.trace[0] == pytest.approx(short.trace[0]) and both.trace[1]["value"] >= both.trace[0]["value"] - 1e-6


def test_erlpboost_rows_has_the_rounds_of_its_sql(spark, tmp_path):
    """Prices alone tell the labels, so that the first round is within half the tolerance of the bound."""
    from boostloom import queries

    rows = [(i, float(1000 + 499000 * i // 399), i % 3 + 1) for i in range(400)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = [tuple(r) for r in queries.erlpboost_rows(spark, str(tmp_path)).collect()]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
        assert found == db.execute(queries.ORACLE_SQL["erlpboost_rows"]).fetchall()


def test_lpboost_over_continuous_scores_has_a_small_gap(sample):
    b = LPBoost(sample).nu(60).tolerance(0.01).force_quit_at(3)
    f = b.over_rows().run(GaussianNB(soft=True))
    assert SoftMargin(60).eval(sample, f) >= b.value - 0.01 / 4 - 1e-6
    values = [r["value"] for r in b.trace]
    assert all(y >= x - 0.01 for x, y in zip(values, values[1:]))


def test_groups_give_way_to_rows_where_margins_take_many_values(sample, monkeypatch):
    from boostloom.plans import programs, totally_corrective

    monkeypatch.setattr(totally_corrective, "Switch", lambda train, rows: programs.Switch(train, rows, most=100))
    b = MAKERS["erlp"](sample)
    f = b.run(GaussianNB(soft=True))
    assert b.programs.over_rows and len(b.programs.inner.hypotheses) == len(b.hypotheses)
    again = MAKERS["erlp"](sample).over_rows()
    assert again.run(GaussianNB(soft=True)).weights == pytest.approx(f.weights, abs=1e-6)
    assert "__g" not in b.train.df.columns


def test_perturbed_programs_follow_their_seed_only(spark, sample):
    a, n = problem(6, 300)
    n[:] = 1
    nu, found = 60.0, []
    for seed, parts in ((1, 2), (1, 5), (2, 2)):
        rows = by_rows(spark, a, n, parts)
        rows.noise = double_log_noise(F.xxhash64("__m0"), seed, 1) / 5
        value, w = rows.soft_margin(nu, 1e-2)
        d = rows.weight()
        table = rows.train.df.select(d.alias("d"), rows.noise.alias("x"), *[f"__m{j}" for j in range(5)]).toPandas().to_numpy()
        d, noise, margins = table[:, 0], table[:, 1], table[:, 2:]
        assert (margins.T @ d).max() + noise @ d == pytest.approx(value, abs=1e-6) and d.max() <= 1 / nu + 1e-9
        assert value - np.sort(margins @ w + noise)[:60].mean() <= 1e-2 + 1e-6
        found.append(w)
    assert found[0] == pytest.approx(found[1], abs=1e-6) and np.abs(found[0] - found[2]).max() > 1e-3
    rows.noise = rows.noise / 1e9
    assert rows.soft_margin(nu, 1e-2)[0] == pytest.approx(solvers.soft_margin_lp(a, n, nu)[0], abs=1e-2)
    noise = spark.range(20000).select(double_log_noise(F.col("id"), 5, 1).alias("x")).toPandas()["x"]
    assert noise.mean() == pytest.approx(-0.5772, abs=0.03) and noise.var() == pytest.approx(np.pi**2 / 6, rel=0.05)
    b = MLPBoost(sample).nu(60).tolerance(0.2).perturbed(1).force_quit_at(1)
    assert b.run(DecisionTree(1)).weights == [1.0] and b.programs.over_rows
    with pytest.raises(ValueError, match="row_id"):
        MLPBoost(Sample(sample.df.drop("row_id"), sample.features)).nu(60).perturbed(1).run(DecisionTree(1))


def test_total_boost_over_rows(sample):
    a, b = TotalBoost(sample).tolerance(0.3).force_quit_at(2), TotalBoost(sample).tolerance(0.3).force_quit_at(2).over_rows()
    a.run(DecisionTree(1))
    b.run(DecisionTree(1))
    assert [r["edge"] for r in a.trace] == pytest.approx([r["edge"] for r in b.trace], abs=1e-4)
