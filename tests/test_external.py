"""Training in partitions, and boosting with models from outside."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boostloom.operators import ExternalLearner, NeuralNetwork, draws, neural, parallel
from boostloom.plans import AdaBoost
from boostloom.queries import fit_centroids, score_centroids
from boostloom.sources import Sample
from boostloom.streaming import score_stream


def _points(spark, n=400, parts=4):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 2))
    rows = [(i, float(a), float(b), 1.0 if a + 2 * b > 0 else -1.0) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y double").repartition(parts, "row_id")
    return Sample(df, ["a", "b"])


def _network():
    return neural.Network([2, 3, 2], [neural.sigmoid(1.5), neural.softmax()], np.random.default_rng(0), 1.0)


@pytest.mark.parametrize("loss", [neural.CROSS_ENTROPY, neural.L2])
def test_the_gradient_of_partitions_is_that_of_all_rows(spark, loss):
    s = _points(spark)
    network = _network() if loss == neural.CROSS_ENTROPY else neural.Network([2, 3, 1], [neural.sigmoid(), neural.identity()], np.random.default_rng(1), 1.0)
    rows = s.df.withColumn(draws.SHARE, (F.col("row_id") % 3) / F.lit(400.0))
    value, g = parallel.gradient(rows, s.features, network, loss)
    p = s.df.toPandas()
    x, share = p[["a", "b"]].to_numpy(), (p["row_id"] % 3).to_numpy() / 400
    target = parallel.targets(p["y"].to_numpy(), len(network.bias[-1]), loss)
    assert g == pytest.approx(network.gradient(x, target, loss, share), abs=1e-12)
    assert value == pytest.approx(float(share @ loss.by_row(network.forward(x), target)))

    def at(weights):
        network.move(weights - network.flat())
        return float(share @ loss.by_row(network.forward(x), target))

    here = network.flat()
    for i in range(len(here)):
        e = np.zeros(len(here))
        e[i] = 1e-6
        assert (at(here + e) - at(here - e)) / 2e-6 == pytest.approx(g[i], abs=1e-6)


def test_no_rows_give_no_gradient(spark):
    rows = _points(spark).df.withColumn(draws.SHARE, F.lit(1.0)).filter("false")
    value, g = parallel.gradient(rows, ["a", "b"], _network(), neural.CROSS_ENTROPY)
    assert value == 0 and not g.any() and len(g) == 3 * 3 + 4 * 2


def test_training_in_partitions_doesnt_depend_on_them(spark):
    def run(parts):
        learner = NeuralNetwork(seed=3).append(4, neural.sigmoid(2.0)).append(2, neural.softmax()).n_epoch(8).n_iter(2).minibatch_size(100).learning_rate(2.0).initial_scale(1.0).in_partitions()
        s = _points(spark, parts=parts)
        return learner, s, learner.fit(s)

    one, s, h = run(1)
    other, _, _ = run(7)
    assert len(one.trace) == 16 and one.trace[-1].loss < one.trace[0].loss
    assert one.trace[-1].weights == pytest.approx(other.trace[-1].weights, abs=1e-9)
    assert h.predict_all(s).filter("prediction = y").count() > 320


def test_draws_are_unbiased_and_whole_where_they_may_be(spark):
    s = _points(spark)
    train = ExternalLearner(fit_centroids, score_centroids).prepare(s)
    weight = F.when(F.col("row_id") < 4, 1000.0).otherwise(F.when(F.col("row_id") < 10, 0.0).otherwise(1.0))
    w = draws.Weighted.of(train, weight, s.features)
    assert w.count == 394 and w.total == 4390
    every = w.draw(394, 1, 0)
    assert every.count() == 394 and every.agg(F.sum(draws.SHARE)).first()[0] == pytest.approx(1)
    # the four heavy rows are in every draw, with their own share
    sizes, sums = [], []
    for i in range(40):
        n, total, heavy = w.draw(100, 1, i).agg(F.count("*"), F.sum(draws.SHARE), F.count_if(F.abs(F.col(draws.SHARE) - 1000 / 4390) < 1e-9)).first()
        sizes.append(n)
        sums.append(total)
        assert heavy == 4
    assert np.mean(sizes) == pytest.approx(4 + 390 * 100 / 4390, abs=2) and np.mean(sums) == pytest.approx(1, abs=0.01)
    with pytest.raises(ValueError, match="positive weight"):
        draws.Weighted.of(train, F.lit(0.0), s.features)


def test_draws_without_ids_and_with_odd_names(spark):
    rows = spark.range(200).select((F.col("id") % 50).cast("double").alias("a.b"), F.when(F.col("id") % 50 < 25, 1.0).otherwise(-1.0).alias("y"))
    s = Sample(rows, ["a.b"])
    h = ExternalLearner(fit_centroids, score_centroids, rows=1000).fit(s)
    assert h.predict_all(s).filter("prediction = y").count() == 200


def test_a_users_model_boosts_and_scores_a_stream(spark, tmp_path):
    s = _points(spark)
    booster = AdaBoost(s).force_quit_at(3)
    f = booster.run(ExternalLearner(fit_centroids, score_centroids, rows=150))
    assert len(booster.weights) == 3 and booster.edges[0] > 0.4
    table = {r["row_id"]: r["prediction"] for r in f.predict_all(s).select("row_id", "prediction").collect()}
    s.df.write.parquet(str(tmp_path / "in"))
    stream = score_stream(spark.readStream.schema(s.df.schema).parquet(str(tmp_path / "in")), f).select("row_id", "prediction")
    query = stream.writeStream.format("memory").queryName("scored_outside").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["row_id"]: r["prediction"] for r in spark.table("scored_outside").collect()} == table


def test_models_that_break_the_contract(spark):
    s = _points(spark, 40)
    with pytest.raises(Exception, match="as many scores"):
        ExternalLearner(fit_centroids, lambda model, x: np.zeros(1)).fit(s).confidence_all(s).collect()
    with pytest.raises(Exception, match="may be broadcast"):
        ExternalLearner(lambda x, y, w: np.zeros(1000), score_centroids, max_bytes=100).fit(s)
    h = ExternalLearner(lambda x, y, w: 0, lambda model, x: np.full(len(x), np.nan)).fit(s)
    assert {r[0] for r in h.confidence_all(s).select("confidence").collect()} == {0.0}
