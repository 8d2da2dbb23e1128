"""Learners on sparse rows against the same ones on dense columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boostloom.functions.losses import L1, L2
from boostloom.operators import GaussianNB, RegressionTree, SparseDecisionTree, SparseGaussianNB, SparseRegressionTree, sparse, sparse_bayes
from boostloom.operators.serial import from_json
from boostloom.plans import GBM
from boostloom.sources.sample import Sample, read_svmlight


@pytest.fixture(scope="module")
def both(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((400, 5)) < 0.6, 0.0, rng.integers(-3, 4, (400, 5))).astype(float)
    x[:, 4] = rng.integers(1, 5, 400)  # no zeros
    y = np.where(x[:, 0] - x[:, 1] + 0.5 * x[:, 4] + rng.normal(0, 1, 400) > 1, 1.0, -1.0)
    rows = [(i, float(v), *map(float, r), {10 * j: float(z) for j, z in enumerate(r) if z or j == 3}) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, y double, " + ", ".join(f"f{j} double" for j in range(5)) + ", features map<int,double>").repartition(3)
    return Sample(df.drop("features"), [f"f{j}" for j in range(5)]), sparse.sparse_sample(df.select("row_id", "y", "features")), y


@pytest.fixture(params=[True, False], ids=["broadcast", "salted"])
def few(request, monkeypatch):
    if not request.param:
        monkeypatch.setattr(sparse, "FEW_FEATURES", 0)
        monkeypatch.setattr(sparse_bayes, "FEW_FEATURES", 0)


@pytest.mark.parametrize("weighted", [False, True])
def test_naive_bayes(both, few, weighted):
    dense, thin, _ = both
    weight = F.when(F.col("row_id") % 3 == 0, 0.5).when(F.col("row_id") % 7 == 0, 0.0).otherwise(1.0) if weighted else None
    d, s = GaussianNB().fit(dense, weight), SparseGaussianNB().fit(thin, weight)
    want = dense.df.orderBy("row_id").select(d.posterior(1.0), d.predict()).toPandas().to_numpy()
    got = s.posterior(thin.df, 1.0).orderBy("row_id").toPandas()["posterior"].to_numpy()
    assert got == pytest.approx(want[:, 0], abs=1e-9)
    assert s.predict_all(thin.df).orderBy("row_id").toPandas()["prediction"].tolist() == want[:, 1].tolist()


def test_naive_bayes_of_odd_rows(spark, both):
    _, thin, y = both
    model = SparseGaussianNB().fit(thin)
    rows = spark.createDataFrame([(0, {}), (1, {999: 5.0}), (2, {0: 0.0}), (3, None), (4, {0: None})], "row_id long, features map<int,double>")
    found = model.posterior(rows, 1.0).orderBy("row_id").toPandas()["posterior"]
    assert found.nunique() == 1, "indices never seen, zeros and nulls count as zeros"
    empty = SparseGaussianNB().fit(thin.with_df(thin.df.withColumn("features", F.create_map().cast("map<int,double>"))))
    assert empty.posterior(rows, 1.0).first()["posterior"] == pytest.approx((y > 0).mean())
    with pytest.raises(ValueError):
        SparseGaussianNB().fit(thin.with_df(thin.df.limit(0)))


@pytest.mark.parametrize("loss", [L2(), L1()])
def test_gbm_on_sparse_rows_is_gbm_on_dense_ones(both, few, loss):
    dense, thin, _ = both
    d = dense.with_df(dense.df.withColumn("y", F.col("f4") * 2 - F.col("f0") + F.col("f2")))
    s = thin.with_df(thin.df.withColumn("y", sparse.value_of(40) * 2 - sparse.value_of(0) + sparse.value_of(20)))
    a, b = GBM(d, loss).max_iter(3), GBM(s, loss).max_iter(3)
    f, g = a.run(RegressionTree(L2(), 3)), b.run(SparseRegressionTree(L2(), 3))
    assert f.weights == pytest.approx(g.weights)
    want = d.df.orderBy("row_id").select(f.predict()).toPandas().to_numpy()
    got = s.df.orderBy("row_id").select(g.predict()).toPandas().to_numpy()
    assert got == pytest.approx(want)
    again = from_json(g.hypotheses[0].to_json())
    assert again.root == g.hypotheses[0].root


def test_trees_go_to_json_and_back(both):
    _, thin, _ = both
    h = SparseDecisionTree(2).fit(thin)
    assert from_json(h.to_json()).root == h.root


def test_svmlight_rows_need_no_column_for_an_index(spark, tmp_path):
    path = tmp_path / "toy.svmlight"
    path.write_text("\n".join(f"{1 if i % 3 else -1} {i * 1000}:{i + 1} 5:{i % 3}" for i in range(60)))
    s = sparse.sparse_sample(read_svmlight(spark, str(path)))
    model = SparseGaussianNB().fit(s)
    assert model.features.count() == 61
    assert model.predict_all(s.df).filter("prediction = y").count() == 60
