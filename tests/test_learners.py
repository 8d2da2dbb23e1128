"""Weak learners and hypotheses."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from boostloom import queries
from boostloom.functions.losses import L1, L2
from boostloom.functions.projection import capped, capped_rows
from boostloom.operators import BadBaseLearner, DecisionTree, GaussianNB, LearnerUnion, NaiveAggregation, NeuralNetwork, RegressionTree, SparseDecisionTree, WeightedMajority, binning, criteria, neural, trees
from boostloom.operators.base import edge_of
from boostloom.operators.serial import from_json
from boostloom.operators.sparse import sparse_sample, value_of
from boostloom.operators.trees import Node, TreeClassifier
from boostloom.plans import AdaBoost
from boostloom.sources.sample import Sample
from boostloom.streaming import score_stream
from tests.test_samples import TOY


@pytest.fixture(scope="module")
def toy(spark):
    return Sample.from_df(spark.createDataFrame(TOY, "row_id long, a double, b double, class double"), ["a", "b"], "class", "row_id")


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 12, (3000, 3))
    y = np.where(x[:, 0] * 2 + x[:, 1] + rng.normal(0, 2, 3000) > 16, 1, -1)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return Sample.from_df(spark.createDataFrame(rows, "row_id long, f0 double, f1 double, f2 double, y double"), ["f0", "f1", "f2"], "y", "row_id"), x, y


@pytest.mark.parametrize("name", list(criteria.CRITERIA))
def test_golden_toy_tree(toy, name):
    h = DecisionTree(2, name).fit(toy)
    assert h.root.feature == "a" and h.root.threshold == pytest.approx(9.0) and h.root.left.value == -1
    assert h.root.right.feature == "b" and h.root.right.threshold == pytest.approx(9.571428571428571)
    assert [n for n in h.root.leaves()] == [-1, 1, -1] and h.edge == pytest.approx(1)
    assert all(r["prediction"] == r["y"] for r in h.predict_all(toy).collect())


@pytest.mark.parametrize("name, root", [("entropy", 0.32133436835360474), ("gini", 0.21428571428571427), ("edge", -0.7142857142857142), ("twoing", -0.1377551020408163)])
def test_golden_scores(name, root):
    c = criteria.CRITERIA[name]
    score = c.score(criteria.ARRAYS, np.array([0.0]), np.array([3 / 7]), 3 / 7, 4 / 7)
    assert float(score[0]) == pytest.approx(root)
    if name == "entropy":
        assert float(c.parent(criteria.ARRAYS, 3 / 7, 4 / 7)) == pytest.approx(0.6829081047004717)


def brute_tree(x, y, d, depth, criterion, bins):
    """A tree over bin numbers, recursively and by rows."""
    c = criteria.CRITERIA[criterion]
    p, q = d[y > 0].sum(), d[y < 0].sum()
    conf = (p - q) / (p + q)
    best = None
    if depth and min(p, q) > 0:
        for f in range(x.shape[1]):
            used = np.unique(x[:, f])
            for a, b in zip(used, used[1:]):
                left = x[:, f] <= a
                s = float(np.round(c.score(criteria.ARRAYS, np.array([d[left & (y > 0)].sum()]), np.array([d[left & (y < 0)].sum()]), p, q)[0], 10))
                if s < c.parent(criteria.ARRAYS, p, q) and (best is None or (s, f, a) < best[:3]):
                    best = (s, f, a, left)
    if best is None:
        return np.full(len(y), conf)
    out, left = np.empty(len(y)), best[3]
    out[left] = brute_tree(x[left], y[left], d[left], depth - 1, criterion, bins)
    out[~left] = brute_tree(x[~left], y[~left], d[~left], depth - 1, criterion, bins)
    return out


@pytest.mark.parametrize("criterion", list(criteria.CRITERIA))
@pytest.mark.parametrize("keep", [False, True])
def test_trees_match_brute_force(grid, criterion, keep):
    s, x, y = grid
    learner = DecisionTree(3, criterion)
    train = learner.prepare(s, keep_rows=keep)
    assert train.m == 3000 and train.df.agg(F.sum("n")).first()[0] == 3000
    bins = train.extra["bins"]
    w = F.lit(1.0) + F.col(binning.bin_column("f2")) / 4  # weights that depend on the bins
    h = learner.produce(train, w)
    want = brute_tree(x, y, 1 + x[:, 2] / 4, 3, criterion, bins)
    got = np.array([r["confidence"] for r in h.confidence_all(s).orderBy("row_id").collect()])
    assert np.allclose(got, want)
    d = 1 + x[:, 2] / 4
    assert h.edge == pytest.approx((d * y * got).sum() / d.sum())
    h.edge = None
    assert edge_of(train, w, h) == pytest.approx((d * y * got).sum() / d.sum())


def test_split_plan_agrees_with_arrays(grid):
    s, _, _ = grid
    train = binning.prepare(s, {}, False)
    n = F.col("n").cast("double")
    table = trees.histogram(train.df, s.features, F.lit(0), [F.when(F.col("y") > 0, n).otherwise(0.0).alias("positive"), F.when(F.col("y") > 0, 0.0).otherwise(n).alias("negative")])
    pdf = table.toPandas().sort_values(["feature", "bin"])
    for c in criteria.CRITERIA.values():
        row = criteria.best_splits(table, c).first()
        best = min((*criteria.best_cut(c, g["positive"].to_numpy(), g["negative"].to_numpy()), f) for f, g in pdf.groupby("feature"))
        assert row["score"] == pytest.approx(best[0]) and row["feature"] == best[2]


def test_zero_weights_are_left_out(toy):
    h = DecisionTree(1).fit(toy, F.when(F.col(binning.bin_column("a")) < 4, 0.0).otherwise(1.0))
    assert h.edge == pytest.approx(1)
    with pytest.raises(ValueError):
        DecisionTree(1).fit(toy, F.lit(0.0))


def test_bins(toy, spark):
    bins, m = binning.make_bins(toy, {"b": 3})
    assert m == 7 and bins["a"].n == 7 and bins["b"].n == 3 and str(bins["b"]).startswith("[-inf, 5)")
    flat, _ = binning.make_bins(Sample.from_df(spark.createDataFrame([(1.0, 1.0), (1.0, -1.0)], "x double, y double"), ["x"], "y"), {})
    assert flat["x"].low == pytest.approx(0.999) and flat["x"].n == 1


def test_pruning_dot_and_json(toy, tmp_path):
    h = DecisionTree(2).fit(toy)
    assert from_json(h.to_json()) == h and "a < 9" in str(h)
    h.to_dot_file(str(tmp_path / "t.dot"))
    text = (tmp_path / "t.dot").read_text()
    assert text.count("shape = box") == 3 and text.count("->") == 4 and "Yes" in text
    learner = DecisionTree(2, prune=True)
    learner._masses = {}
    leaf = lambda p, q: learner._masses.setdefault(id(n := Node(1.0)), (p, q)) and n
    root = Node(0.5, "a", 1.0, 0, leaf(5.0, 1.0), leaf(4.0, 1.0))
    learner._masses[id(root)] = (9.0, 2.0)
    learner._collapse(root)
    assert root.feature is None
    with pytest.raises(ValueError):
        DecisionTree(0)


def brute_regression(x, y, levels, lam=0.01):
    if not levels:
        return np.full(len(y), y.sum() / (len(y) + lam))
    best = None
    for f in range(x.shape[1]):
        for a in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= a
            s = -round(y[left].sum() ** 2 / (left.sum() + lam) + y[~left].sum() ** 2 / ((~left).sum() + lam), 8)
            if best is None or (s, f, a) < best[:3]:
                best = (s, f, a, left)
    if best is None:
        return np.full(len(y), y.sum() / (len(y) + lam))
    out, left = np.empty(len(y)), best[3]
    out[left], out[~left] = brute_regression(x[left], y[left], levels - 1), brute_regression(x[~left], y[~left], levels - 1)
    return out


def test_regression_trees(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (800, 2))
    y = np.round(x[:, 0] * 1.5 - x[:, 1] + rng.normal(0, 1, 800), 3)
    s = Sample.from_df(spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "row_id long, f0 double, f1 double, y double"), ["f0", "f1"], "y", "row_id")
    for depth in (1, 2, 3):
        learner = RegressionTree(L2(), depth)
        h = learner.produce(learner.prepare(s), F.lit(0.0))
        got = [r["prediction"] for r in h.predict_all(s).orderBy("row_id").collect()]
        assert np.allclose(got, brute_regression(x, y, depth - 1))
    l1 = RegressionTree(L1(), 2)
    assert from_json(l1.produce(l1.prepare(s), F.lit(0.0)).to_json()).root.feature in ("f0", "f1")


def test_naive_bayes(toy):
    h = GaussianNB().fit(toy)
    a = np.array([r[1:3] for r in TOY])
    y = np.array([r[3] for r in TOY])

    def log_joint(label):
        mine = a[y == label]
        m, v = mine.mean(0), mine.var(0)
        return np.log((y == label).mean()) - 0.5 * (np.log(2 * np.pi * v) + (a - m) ** 2 / v).sum(1)

    rows = toy.df.select("row_id", h.posterior(1.0).alias("p"), h.predict().alias("c")).orderBy("row_id").collect()
    want = 1 / (1 + np.exp(log_joint(-1) - log_joint(1)))
    assert np.allclose([r["p"] for r in rows], want) and [r["c"] for r in rows] == np.where(want >= 0.5, 1, -1).tolist()
    assert json.loads(h.to_json())["kind"] == "gaussian_nb" and from_json(h.to_json()).classes[0]["label"] == -1


def test_soft_naive_bayes_is_the_difference_of_posteriors(toy):
    h = GaussianNB(soft=True).fit(toy)
    rows = toy.df.select(h.confidence().alias("c"), (h.posterior(1.0) - h.posterior(-1.0)).alias("d")).collect()
    assert [r["c"] for r in rows] == pytest.approx([r["d"] for r in rows], abs=1e-12) and len(rows) == 7


def test_bad_learner_edges_match_their_columns(spark):
    learner = BadBaseLearner(1e-3, 2.0)
    train = learner.prepare(Sample.dummy(spark, 21))
    w = 1.0 + F.col("row_id") % 5
    edges = learner.edges(train, w)["edge"].to_numpy()
    assert len(edges) == 12
    for h, e in zip(train.extra["classifiers"], edges):
        assert edge_of(train, w, h) == pytest.approx(e, abs=1e-12)
    assert learner.produce(train, w) == train.extra["classifiers"][int(edges.argmax())]
    with pytest.raises(ValueError):
        BadBaseLearner(1e-9, 50.0).prepare(Sample.dummy(spark, 10))


def test_network_learns_and_its_gradient_is_right(spark):
    rng = np.random.default_rng(2)
    net = neural.Network([2, 4, 2], [neural.sigmoid(1.5), neural.softmax()], rng, scale=1.0)
    x, t = rng.normal(size=(6, 2)), neural.one_hot(rng.choice([-1, 1], 6), 2)
    loss = lambda: -(t * np.log(net.forward(x))).sum()
    before = [w.copy() for w in net.weights]
    numeric = np.zeros_like(net.weights[0])
    for i in np.ndindex(numeric.shape):
        net.weights[0][i] += 1e-6
        up = loss()
        net.weights[0][i] -= 2e-6
        numeric[i] = (up - loss()) / 2e-6
        net.weights[0][i] += 1e-6
    net.train(x, t, 1.0)
    assert np.allclose(before[0] - net.weights[0], numeric, atol=1e-5)
    pts = rng.uniform(-1, 1, (400, 2))
    rows = [(float(a), float(b), 1.0 if a + b > 0 else -1.0) for a, b in pts]
    s = Sample.from_df(spark.createDataFrame(rows, "u double, v double, y double"), ["u", "v"], "y")
    learner = NeuralNetwork(seed=3).append(8, neural.relu(0.0)).append(2, neural.softmax()).n_epoch(20).n_iter(200)
    h = learner.fit(s)
    assert h.predict_all(s).filter("prediction = y").count() > 360 and h.network.stats()["n"] == 32
    assert (neural.identity()(pts) == pts).all() and neural.relu(0.5).slope(np.array([0.4, 0.6])).tolist() == [0, 1]


def test_network_regression(spark):
    s = Sample.from_df(spark.range(200).select((F.col("id") / 100 - 1).alias("u"), (F.col("id") / 50 - 2).alias("y")), ["u"], "y")
    h = NeuralNetwork(task="regression").append(1, neural.identity()).n_epoch(30).n_iter(1000).minibatch_size(64).fit(s)
    assert h.predict_all(s).agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.3


def test_weighted_majority(toy, spark):
    a, b = (TreeClassifier(Node(0.0, f, 9.0, 0, Node(-1.0), Node(1.0))) for f in ("a", "b"))
    f = WeightedMajority.from_slices([3.0, 1.0, 0.0], [a, b, a])
    assert f.weights == [0.75, 0.25] and f.decompose()[1] == [a, b]
    again = WeightedMajority.from_json(f.to_json())
    assert again.weights == f.weights and again.hypotheses == f.hypotheses
    got = f.score(toy.df, at_once=1).select("row_id", "confidence", f.confidence().alias("c")).collect()
    assert all(r["confidence"] == pytest.approx(r["c"]) for r in got)
    with pytest.raises(ValueError):
        WeightedMajority.from_slices([0.0, -1.0], [a, b])
    f.push(1.0, b)
    assert sum(f.normalize().weights) == pytest.approx(1)
    assert score_stream(toy.df, f).count() == 7


def test_naive_aggregation(toy):
    a, b = (TreeClassifier(Node(0.0, f, 9.0, 0, Node(-1.0), Node(1.0))) for f in ("a", "b"))
    h = NaiveAggregation.learned([a, b], toy.df)
    rows = h.predict_all(toy).collect()
    assert all(r["prediction"] == (1 if r["a"] >= 9 and r["b"] < 9 else -1) for r in rows)
    assert h.predict_rows(toy.df).select("prediction").collect() == toy.df.select(h.predict().alias("prediction")).collect()
    assert NaiveAggregation.from_slice([a, b], h.signatures).predict_all(toy).count() == 7


def test_naive_aggregation_query_learns_from_all_rows(spark, tmp_path):
    rows = [(1, "BUILDING", 1.0, 1), (2, "MACHINERY", 2.0, 2), (3, "MACHINERY", 5000.0, 20)]  # no key is a multiple of 20
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    got = queries.naive_aggregation(spark, str(tmp_path)).collect()
    assert {r["row_id"]: r["prediction"] for r in got} == {1: 1, 2: 1, 3: -1}


def test_union_takes_the_larger_edge(grid):
    s, _, _ = grid
    learner = LearnerUnion(DecisionTree(1), DecisionTree(3))
    train = learner.prepare(s)
    assert learner.produce(train, F.lit(1.0)).edge == pytest.approx(DecisionTree(3).fit(s).edge)


def test_scoring_a_stream(spark, toy, tmp_path):
    toy.df.write.parquet(str(tmp_path / "in"))
    h = DecisionTree(2).fit(toy)
    stream = score_stream(spark.readStream.schema(toy.df.schema).parquet(str(tmp_path / "in")), h)
    q = stream.writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").filter("prediction = y").count() == 7


def sparse_rows(spark, n=400, features=12, seed=0):
    """Rows of (row_id, y, map), and the same as a matrix; indices are far apart and one is never there."""
    rng = np.random.default_rng(seed)
    index = np.arange(features) * 1000 + 3
    x = np.where(rng.random((n, features)) < 0.25, rng.integers(-4, 9, (n, features)), 0).astype(float)
    x[:, 1] = rng.integers(1, 5, n)  # in every row
    y = np.where(x[:, 0] + x[:, 1] - 2 * x[:, 2] + rng.normal(0, 2, n) > 2, 1.0, -1.0)
    explicit = rng.random((n, features)) < 0.05  # zeros may also be written down
    rows = [(i, float(y[i]), {int(index[j]): float(x[i, j]) for j in range(features) if x[i, j] or explicit[i, j]}) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y double, features map<int, double>"), x, y, index


@pytest.mark.parametrize("criterion,depth", [("entropy", 1), ("gini", 2), ("edge", 3)])
def test_sparse_trees_are_those_of_dense_columns(spark, criterion, depth):
    rows, x, _, index = sparse_rows(spark, seed=depth)
    sparse = SparseDecisionTree(depth, criterion).fit(sparse_sample(rows))
    columns = [value_of(int(i)).alias(f"f{j:02d}") for j, i in enumerate(index)]
    dense_rows = rows.select("row_id", "y", "features", *columns)
    dense = DecisionTree(depth, criterion).fit(Sample(dense_rows, [f"f{j:02d}" for j in range(len(index))]))
    got = dense_rows.select(sparse.confidence().alias("a"), dense.confidence().alias("b")).collect()
    assert all(r["a"] == pytest.approx(r["b"]) for r in got) and sparse.edge == pytest.approx(dense.edge)


def test_sparse_boosting_and_odd_rows(spark):
    rows, _, _, index = sparse_rows(spark)
    f = AdaBoost(sparse_sample(rows)).force_quit_at(3).run(SparseDecisionTree(2))
    dense = Sample(rows.select("y", *[value_of(int(i)).alias(f"f{j:02d}") for j, i in enumerate(index)]), [f"f{j:02d}" for j in range(len(index))])
    assert f.weights == pytest.approx(AdaBoost(dense).force_quit_at(3).run(DecisionTree(2, "entropy")).weights)
    odd = spark.createDataFrame([(1.0, {5: 1.0}), (1.0, {5: 2.0, 7: None}), (-1.0, {}), (-1.0, None), (-1.0, {7: 0.0})], "y double, features map<int, double>")
    h = SparseDecisionTree(2).fit(sparse_sample(odd))
    assert [r["prediction"] for r in h.predict_all(sparse_sample(odd)).collect()] == [1, 1, -1, -1, -1] and h.edge == pytest.approx(1)
    none = SparseDecisionTree(2).fit(sparse_sample(odd.withColumn("features", F.lit(None).cast("map<int,double>"))))
    assert none.root == pytest.approx(-0.2)


def test_json_of_networks_and_aggregations(spark, toy):
    network = NeuralNetwork().append(4, neural.relu(0.0)).append(2, neural.softmax()).n_epoch(2).n_iter(3).fit(toy)
    again = from_json(network.to_json())
    pairs = toy.df.select(network.confidence().alias("a"), again.confidence().alias("b")).collect()
    assert all(r["a"] == r["b"] for r in pairs)
    h = NaiveAggregation.learned([DecisionTree(1).fit(toy), DecisionTree(1, "edge").fit(toy)], toy.df)
    both = toy.df.select(h.predict().alias("a"), from_json(h.to_json()).predict().alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both)


def test_network_losses():
    p, t = np.array([[0.2, 0.8], [0.5, 0.5]]), np.array([[0.0, 1.0], [1.0, 0.0]])
    assert neural.CROSS_ENTROPY.value(p, t) == pytest.approx(-(np.log(0.8) + np.log(0.5)) / 2)
    assert neural.CROSS_ENTROPY.value(p[:, 1:], t[:, 1:]) == pytest.approx(-(np.log(0.8) + np.log(0.5)) / 2)
    assert neural.L2.value(p, t) == pytest.approx((0.08 / 2 + 0.5 / 2) / 2)
    assert (neural.L2.gradient(p, t) == p - t).all()


@pytest.mark.parametrize("kind", ["spread", "two values", "one value", "clusters"])
def test_capped_rows_match_the_sorted_solution(spark, kind):
    rng = np.random.default_rng(4)
    n = 3000
    l = {"spread": rng.normal(0, 2, n), "two values": rng.integers(0, 2, n) * 3.0, "one value": np.ones(n), "clusters": rng.integers(0, 3, n) + rng.random(n) * 1e-9}[kind]
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(l)], "i long, l double")
    for nu in (1.0, 40.0, 1500.0, float(n)):
        got = np.array([r["d"] for r in capped_rows(rows, F.col("l"), nu, few=50, bins=8).orderBy("i").collect()])
        assert np.allclose(got, capped(l, np.ones(n), 1 / nu), rtol=1e-9, atol=1e-15) and got.sum() == pytest.approx(1)
    assert capped_rows(rows.limit(0), F.col("l"), 3.0).count() == 0
