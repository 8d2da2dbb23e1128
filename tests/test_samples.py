"""Samples, readers and statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boostloom.functions import losses, projection, stats
from boostloom.sources.sample import Sample, SampleReader, densify, places, read_csv, read_svmlight, with_row_id

TOY = [(0, 10.0, 5.0, 1.0), (1, 14.0, 8.0, 1.0), (2, 15.0, 3.0, 1.0), (3, 5.0, 1.0, -1.0), (4, 3.0, 9.0, -1.0), (5, 8.0, 13.0, -1.0), (6, 12.0, 11.0, -1.0)]


@pytest.fixture(scope="module")
def toy(spark):
    return Sample.from_df(spark.createDataFrame(TOY, "row_id long, a double, b double, class double"), ["a", "b"], "class", "row_id")


def test_shape_targets_and_rows(toy):
    assert toy.shape() == (7, 2) and toy.unique_target() == [-1.0, 1.0] and toy.at(3) == ([5.0, 1.0], -1.0)
    assert toy.is_valid_binary_instance()
    with pytest.raises(IndexError):
        toy.at(99)
    with pytest.raises(KeyError):
        toy["nothing"]


def test_names_and_targets(spark, toy):
    renamed, old = toy.replace_names(["p", "q"])
    assert old == ["a", "b"] and renamed.at(0) == ([10.0, 5.0], 1.0)
    with pytest.raises(ValueError):
        toy.replace_names(["p"])
    raw = Sample.from_df(spark.createDataFrame(TOY, "row_id long, a double, b double, class double"), ["a", "b", "class"])
    assert raw.set_target("class").features == ["a", "b"]
    with pytest.raises(KeyError):
        raw.set_target("z")


def test_invalid_targets(spark):
    for y in ([1.0, 1.0], [0.5, 1.0], [0.0, 1.0, 2.0]):
        s = Sample.from_df(spark.createDataFrame([(float(i), v) for i, v in enumerate(y)], "x double, y double"), ["x"], "y")
        assert not s.is_valid_binary_instance()
    with pytest.raises(ValueError, match="null"):
        Sample.from_df(spark.createDataFrame([(1.0, None), (2.0, 1.0)], "x double, y double"), ["x"], "y")


def test_dummy_and_counts(spark, toy):
    d = Sample.dummy(spark, 5)
    assert [r["y"] for r in d.df.orderBy("row_id").collect()] == [1, 1, -1, -1, -1]
    counts = {r["feature"]: r for r in toy.append(toy).feature_counts().collect()}
    assert (counts["a"]["n_rows"], counts["a"]["n_distinct"], counts["b"]["n_zero"], counts["b"]["max_value"]) == (14, 7, 0, 13.0)


def test_split_and_places(spark, toy):
    train, test = toy.split(2, 4)
    assert [r["row_id"] for r in test.df.orderBy("row_id").collect()] == [2, 3] and train.shape()[0] == 5
    train, test = toy.split(0, 2, F.col("a"))
    assert {r["row_id"] for r in test.df.collect()} == {3, 4}
    many = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") * 7919 % 1000).alias("k"))
    assert {(r["k"], r["p"]) for r in places(many, F.col("k"), "p").collect()} == {(i, i) for i in range(1000)}


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a, b ,class\n1, 2.5,1\n3,4,-1\n")
    s = SampleReader().file(str(tmp_path / "x.csv")).has_header(True).target_feature("class").read(spark)
    assert s.features == ["a", "b"] and s.at(0) == ([1.0, 2.5], 1.0)
    (tmp_path / "y.csv").write_text("1,2,1\n3,4,-1\n")
    assert [c for c in read_csv(spark, str(tmp_path / "y.csv")).columns if c != "row_id"] == ["Feat. [1]", "Feat. [2]", "Feat. [3]"]
    (tmp_path / "z.csv").write_text("a,class\nx,1\n")
    with pytest.raises(Exception):
        SampleReader().file(str(tmp_path / "z.csv")).has_header(True).target_feature("class").read(spark).df.collect()
    with pytest.raises(ValueError):
        SampleReader().file(str(tmp_path / "x.csv")).read(spark)


def test_svmlight(spark, tmp_path):
    (tmp_path / "x.svmlight").write_text("1 0:1.5 4:2\n-1 4:3\n\n1\n")
    rows = read_svmlight(spark, str(tmp_path / "x.svmlight")).orderBy("row_id").collect()
    assert [(r["y"], r["features"]) for r in rows] == [(1.0, {0: 1.5, 4: 2.0}), (-1.0, {4: 3.0}), (1.0, {})]
    s = SampleReader().file(str(tmp_path / "x.svmlight")).read(spark)
    assert s.features == ["Feat. [1]", "Feat. [5]"] and s.at(1) == ([0.0, 3.0], -1.0)
    assert densify(read_svmlight(spark, str(tmp_path / "x.svmlight"))).shape() == (3, 2)


def test_row_ids_follow_the_order_of_reading(spark):
    rows = with_row_id(spark.range(1000).repartition(5).coalesce(3)).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(1000))


def test_moments(toy):
    by = {(r["y"], r["feature"]): r for r in stats.label_moments(toy, F.lit(1 / 7)).collect()}
    assert by[1.0, "a"]["mean"] == pytest.approx(13) and by[1.0, "a"]["variance"] == pytest.approx(14 / 3)
    assert by[-1.0, "b"]["mean"] == pytest.approx(8.5) and by[-1.0, "b"]["variance"] == pytest.approx(20.75)
    all_rows = {r["feature"]: r for r in stats.moments(toy, F.lit(1 / 7)).collect()}
    assert all_rows["a"]["mean"] == pytest.approx(np.mean([r[1] for r in TOY]))
    assert all_rows["b"]["variance"] == pytest.approx(np.var([r[2] for r in TOY]))


def test_entropy_edges_and_norms(toy):
    d = F.lit(1 / 7)
    got = toy.df.agg(stats.entropy(d), stats.entropy_from_uniform(d), stats.edge(d, F.lit(1.0)), stats.label_weight(d, 1.0)).first()
    assert got[0] == pytest.approx(-math.log(7)) and got[1] == pytest.approx(0) and got[2] == pytest.approx(-1 / 7) and got[3] == pytest.approx(3 / 7)
    assert stats.normalized(toy.df, "a").agg(F.sum("a")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        stats.normalized(toy.df.withColumn("a", F.lit(0.0)), "a")
    assert stats.log_sum_exp(toy.df, F.col("a") * 100) == pytest.approx(1500)


@pytest.mark.parametrize("few", [3, 10_000])
def test_weighted_median_and_tail(spark, few, monkeypatch):
    rng = np.random.default_rng(few)
    v, w = rng.normal(size=400).round(2), rng.integers(1, 9, 400)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, w)], "v double, w long")
    order = np.argsort(v, kind="stable")
    want = v[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)]
    bracket = stats._bracket
    monkeypatch.setattr(stats, "_bracket", lambda r, g: bracket(r, g, few=few, bins=8))
    assert stats.weighted_median(rows, F.col("v"), F.col("w").cast("double")) == want
    full = np.sort(np.repeat(v, w))
    for mass in (1, 7, 100.5, w.sum()):
        whole = int(mass)
        tail = (full[:whole].sum() + (mass - whole) * (full[whole] if whole < len(full) else 0)) / mass
        assert stats.lower_tail_mean(rows, F.col("v"), F.col("w"), float(mass)) == pytest.approx(tail)


def test_tail_means_work_values_out_once(spark):
    """However many aggregates narrow the tail down."""
    seen = spark.sparkContext.accumulator(0)
    value = F.udf(lambda i: seen.add(1) or float(i % 50_000), "double")
    rows = spark.range(60_000)
    assert stats.lower_tail_mean(rows, value("id"), F.lit(1), 30_000.0) == pytest.approx(sum(min(2, 1 + (i < 10_000)) * i for i in range(20_000)) / 30_000)
    assert seen.value == 60_000


def test_objectives_agree(spark):
    class Fixed:
        def confidence(self, binned=False):
            return F.col("c")

    rows = spark.createDataFrame([(float(c), float(y)) for c, y in [(0.5, 1), (-0.2, 1), (0.3, -1), (-0.9, -1)]], "c double, y double")
    s = Sample(rows, ["c"])
    assert losses.SoftMargin(1).eval(s, Fixed()) == losses.HardMargin().eval(s, Fixed()) == pytest.approx(-0.3)
    assert losses.SoftMargin(2).eval(s, Fixed()) == pytest.approx(-0.25)
    assert losses.ExponentialLoss().eval(s, Fixed()) == pytest.approx((2 * math.exp(-1) + 2 * math.exp(1)) / 4)


def test_losses(spark):
    rows = spark.createDataFrame([(1.0, 3.0, 1.0), (2.0, 1.0, 2.0), (4.0, 4.0, 0.0)], "p double, y double, h double")
    l1, l2 = losses.L1(), losses.L2()
    got = rows.agg(l1.mean(F.col("p")), l2.mean(F.col("p")), F.sum(l1.gradient(F.col("p"), F.col("y"))), F.sum(l2.gradient(F.col("p"), F.col("y")))).first()
    assert tuple(got) == pytest.approx((1.0, 5 / 3, 0.0, -1.0))
    assert l2.best_coefficient(rows, F.col("y") - F.col("p"), F.col("h")) == pytest.approx(0)
    assert l1.best_coefficient(rows, F.col("y") - F.col("p"), F.col("h")) == pytest.approx(-0.5)


@pytest.mark.parametrize("nu", [1, 3, 10, 40])
def test_capped_projection(spark, nu):
    rng = np.random.default_rng(nu)
    l = np.round(rng.normal(size=40) * 3, 1)
    d = projection.capped(l, np.ones(40), 1 / nu)
    assert d.sum() == pytest.approx(1) and d.max() <= 1 / nu + 1e-12
    free = d < 1 / nu - 1e-9
    if free.sum() > 1:
        ratio = d[free] / np.exp(l[free])
        assert ratio.max() == pytest.approx(ratio.min())
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(l)], "i long, l double")
    got = {r["i"]: r["d"] for r in projection.capped_rows(rows, F.col("l"), nu).collect()}
    assert np.allclose([got[i] for i in range(40)], d)
    values, counts = np.unique(l, return_counts=True)
    assert np.allclose(projection.capped(values, counts, 1 / nu), [d[l == v][0] for v in values])
