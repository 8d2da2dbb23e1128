"""Queries over the test tables, one or more for each operator, and SQL for those that it can express.

SQL is written from the definitions, not from the DataFrame plans.  Doubles are rounded, since the two
engines add them up in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boostloom import lineage
from boostloom.functions import losses, projection, stats
from boostloom.operators import BadBaseLearner, DecisionTree, ExternalLearner, GaussianNB, LearnerUnion, NaiveAggregation, NeuralNetwork, RegressionTree, SparseGaussianNB, WeightedMajority
from boostloom.operators import binning, criteria, neural, sparse, trees
from boostloom.operators.trees import Node, TreeClassifier
from boostloom.plans import GBM, AdaBoost, AdaBoostV, CERLPBoost, CrossValidation, ERLPBoost, ExpLev, GraphSepBoost, LoggerBuilder, LPBoost, MadaBoost, MLPBoost, SmoothBoost, SoftBoost, SquareLevR, TotalBoost
from boostloom.plans import programs
from boostloom.sources.sample import Sample, read_svmlight, validation

Query = Callable[[SparkSession, str], DataFrame]
FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def lineitems(spark: SparkSession, sf_dir: str, check: bool = False) -> Sample:
    """Is the discounted quantity at least 24?"""
    rows = _table(spark, sf_dir, "lineitem")
    return Sample.from_df(rows, FEATURES, F.when(F.col("l_quantity") * (1 - F.col("l_discount")) >= 24, 1).otherwise(-1), check=check)


def orders(spark: SparkSession, sf_dir: str) -> Sample:
    """Do price and customer number together exceed a bound?  Keyed by row_id."""
    rows = _table(spark, sf_dir, "orders")
    return Sample.from_df(rows, ["o_totalprice", "o_custkey"], F.when(F.col("o_totalprice") + 100 * F.col("o_custkey") >= 250000, 1).otherwise(-1), "o_orderkey", check=False)


def revenue(spark: SparkSession, sf_dir: str) -> Sample:
    """Regression: the discounted and taxed quantity."""
    rows = _table(spark, sf_dir, "lineitem")
    return Sample.from_df(rows, ["l_quantity", "l_discount"], F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), check=False)


LINEITEMS = "SELECT l_quantity, l_discount, l_tax, l_extendedprice, CASE WHEN l_quantity * (1 - l_discount) >= 24 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM lineitem"
ORDERS = "SELECT o_totalprice, o_custkey::DOUBLE AS o_custkey, o_orderkey AS row_id, CASE WHEN o_totalprice + 100 * o_custkey >= 250000 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM orders"
REVENUE = "SELECT l_quantity, l_discount, l_quantity * (1 - l_discount) * (1 + l_tax) AS y FROM lineitem"


def stump(feature: str, threshold: float, left: float, right: float) -> TreeClassifier:
    return TreeClassifier(Node(0.0, feature, threshold, 0, Node(left), Node(right)))


#: Fixed hypotheses for queries about scoring: (feature, threshold, value on the left, value on the right), weight.
FIXED = [(("l_quantity", 24.5, -0.9, 0.8), 0.6), (("l_discount", 0.055, 0.3, -0.2), 0.3), (("l_tax", 0.04, -0.1, 0.1), 0.1)]
FIXED_SQL = "(0.6 * CASE WHEN l_quantity < 24.5 THEN -0.9 ELSE 0.8 END + 0.3 * CASE WHEN l_discount < 0.055 THEN 0.3 ELSE -0.2 END + 0.1 * CASE WHEN l_tax < 0.04 THEN -0.1 ELSE 0.1 END)"


def fixed() -> WeightedMajority:
    return WeightedMajority([w for _, w in FIXED], [stump(*h) for h, _ in FIXED])


# -- samples and statistics


def sample_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation(orders(spark, sf_dir))


def sample_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitems(spark, sf_dir, check=True).feature_counts()


def sample_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitems(spark, sf_dir).target().groupBy("y").agg(F.count(F.lit(1)).alias("n_rows"))


def sample_dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Sample.dummy(spark, 1001).df.select("row_id", "dummy", F.col("y"))


def _with_price(spark: SparkSession, sf_dir: str) -> Sample:
    rows = _table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_quantity") * (1 - F.col("l_discount")) >= 24, 1).otherwise(-1)
    return Sample.from_df(rows, [*FEATURES, "l_extendedprice"], y, check=False)


def _price_weight(s: Sample) -> Column:
    total = s.df.agg(F.sum("l_extendedprice")).first()[0]
    return F.col("l_extendedprice") / F.lit(total)


def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_price(spark, sf_dir)
    s = Sample(s.df, FEATURES)
    return stats.moments(s, _price_weight(s)).select("feature", _r("mean").alias("mean"), _r("variance").alias("variance"))


def label_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_price(spark, sf_dir)
    s = Sample(s.df, FEATURES)
    return stats.label_moments(s, _price_weight(s)).select("y", "feature", _r("weight").alias("weight"), _r("mean").alias("mean"), _r("variance").alias("variance"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_price(spark, sf_dir)
    d, h, f = _price_weight(s), stump(*FIXED[0][0]), fixed()
    return s.df.agg(
        _r(stats.edge(d, h.confidence())).alias("edge"), _r(stats.edge(d, f.confidence())).alias("combined_edge"), _r(stats.label_weight(d, 1.0)).alias("positive_weight"),
        _r(stats.inner_product(d, F.col("l_tax"))).alias("inner_product"), _r(stats.zero_one_loss(f.predict())).alias("zero_one"), _r(F.min(stats.margin(f.confidence()))).alias("least_margin"),
    )


def regression_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_quantity") * 0.97
    return revenue(spark, sf_dir).df.agg(_r(losses.L1().mean(p)).alias("l1"), _r(losses.L2().mean(p)).alias("l2"))


def entropy_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir)
    rows = stats.normalized(s.df, "o_totalprice")
    d = F.col("o_totalprice")
    return rows.agg(_r(stats.entropy(d)).alias("entropy"), _r(stats.entropy_from_uniform(d)).alias("divergence"), _r(F.lit(stats.log_sum_exp(s.df, F.col("o_custkey") / 100))).alias("log_sum_exp"))


# -- objectives, projections, medians


def objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, f = lineitems(spark, sf_dir), fixed()
    m = s.shape()[0]
    rows = [("soft margin", losses.SoftMargin(m // 10).eval(s, f)), ("hard margin", losses.HardMargin().eval(s, f)), ("exponential, labels", losses.ExponentialLoss().eval(s, f)), ("exponential, confidences", losses.ExponentialLoss("confidence").eval(s, f))]
    return spark.createDataFrame(rows, "objective string, value double").select("objective", _r("value").alias("value"))


def capped_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir)
    m = s.shape()[0]
    rows = projection.capped_rows(s.df, F.round(F.col("o_totalprice") / 100000, 2), m // 3)
    return rows.select("row_id", _r(F.col("d") * m).alias("scaled_weight"))


def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = stats.weighted_median(_table(spark, sf_dir, "orders"), F.round("o_totalprice", 2), F.col("o_custkey").cast("double"))
    return spark.createDataFrame([(float(value),)], "weighted_median double")


# -- bins, histograms, splits, trees


def _prepared(spark: SparkSession, sf_dir: str):
    return binning.prepare(lineitems(spark, sf_dir), {}, keep_rows=False)


def bin_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = binning.prepare(orders(spark, sf_dir), {}, keep_rows=True)
    return train.df.select("row_id", F.col(binning.bin_column("o_totalprice")).alias("price_bin"), F.col(binning.bin_column("o_custkey")).alias("customer_bin"))


def _masses() -> list[Column]:
    n = F.col("n").cast("double")
    return [F.when(F.col("y") > 0, n).otherwise(0.0).alias("positive"), F.when(F.col("y") > 0, 0.0).otherwise(n).alias("negative")]


def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _prepared(spark, sf_dir)
    return trees.histogram(train.df, FEATURES, F.lit(0), _masses()).select("feature", "bin", "positive", "negative")


def grad_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = revenue(spark, sf_dir)
    train = binning.prepare(s, {}, keep_rows=False)
    loss, y, n = losses.L2(), F.col("y"), F.col("n")
    sums = [(n * loss.gradient(F.lit(10.0), y)).alias("g"), (n * loss.hessian(F.lit(10.0), y)).alias("h")]
    return trees.histogram(train.df, s.features, F.lit(0), sums).select("feature", "bin", _r("g", 4).alias("g"), "h")


def _sparse(spark: SparkSession, sf_dir: str, target: Column | None = None) -> Sample:
    """The line items as rows of (index, value), without the zeros; four more indices are 0 in most rows."""
    rows = lineitems(spark, sf_dir).df if target is None else _table(spark, sf_dir, "lineitem").withColumn("y", target)
    entries = F.map_from_arrays(F.array(*[F.lit(i) for i in range(3)]), F.array(*[F.col(f) for f in FEATURES]))
    rare = F.map_from_arrays(F.array(F.lit(3) + F.col("l_quantity").cast("int") % 4), F.array(F.when(F.col("l_discount") > 0.09, F.col("l_tax")).otherwise(0.0)))
    return sparse.sparse_sample(rows.select("y", F.map_filter(F.map_concat(entries, rare), lambda _, v: v != 0).alias("features")))


def sparse_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = sparse.SparseDecisionTree().prepare(_sparse(spark, sf_dir))
    p, q = _masses()
    table = sparse.sparse_histogram(train.df, train.extra["bins"], train.extra["few"], F.lit(0), p, q)
    return table.filter("positive + negative > 0").select("feature", "bin", "positive", "negative")


def sparse_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sparse(spark, sf_dir)
    h = sparse.SparseDecisionTree(1, "entropy").fit(s)
    feature, threshold, left, right = h.root
    rows = [(feature, threshold, left, right, h.edge)]
    return spark.createDataFrame(rows, "feature int, threshold double, left_value double, right_value double, edge double").select("feature", *[_r(c).alias(c) for c in ("threshold", "left_value", "right_value", "edge")])


def sparse_gbm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sparse(spark, sf_dir, F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    booster = GBM(s, losses.L2()).max_iter(2)
    f = booster.run(sparse.SparseRegressionTree(losses.L2(), 2))
    rows = [(i + 1, h.root[0], h.root[1], w, float(s.df.agg(losses.L2().mean(WeightedMajority(f.weights[: i + 1], f.hypotheses[: i + 1]).predict())).first()[0])) for i, (w, h) in enumerate(zip(f.weights, f.hypotheses, strict=True))]
    return spark.createDataFrame(rows, "round int, feature int, threshold double, coefficient double, l2 double").select("round", "feature", _r("threshold").alias("threshold"), _r("coefficient").alias("coefficient"), _r("l2", 4).alias("l2"))


def svmlight_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an SVMLight file with an index for each of 100,000 numbers of customers; naive Bayes on its entries."""
    rows = _table(spark, sf_dir, "orders")
    y = F.when(F.col("o_totalprice") + 100 * F.col("o_custkey") >= 250000, 1).otherwise(-1)
    index = 2 + F.col("o_custkey") % 100_000
    line = F.format_string("%d 0:%s 1:%s %d:1", y, F.col("o_orderkey").cast("string"), (F.col("o_totalprice") / 100000).cast("string"), index)
    path = lineage.place(spark)
    rows.select(line.alias("value")).write.text(path)
    read = read_svmlight(spark, path)
    key = F.col("features")[0].cast("long").alias("row_id")  # the file's own number of the order, which isn't a feature
    s = sparse.sparse_sample(read.select(key, "y", F.map_filter("features", lambda k, _: k > 0).alias("features")))
    model = SparseGaussianNB().fit(s)
    return model.posterior(s.df, 1.0).select("row_id", "y", _r("posterior", 4).alias("posterior"))


def split(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train = _prepared(spark, sf_dir)
        best = criteria.best_splits(trees.histogram(train.df, FEATURES, F.lit(0), _masses()), criteria.CRITERIA[name])
        bins = train.extra["bins"]
        width = F.array(*[F.lit(bins[f].width) for f in FEATURES])[F.col("feature")]
        low = F.array(*[F.lit(bins[f].low) for f in FEATURES])[F.col("feature")]
        threshold = low + width * (F.col("bin") + 1 + F.col("next_bin")) / 2
        return best.select("feature", _r(threshold).alias("threshold"), _r("score").alias("score"))

    return run


def tree_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir)
    h = DecisionTree(2, "gini").fit(s)
    return h.confidence_all(s).select("row_id", _r("confidence").alias("confidence"), h.predict().alias("prediction"))


def regression_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = revenue(spark, sf_dir)
    learner = RegressionTree(losses.L2(), 2)
    h = learner.produce(learner.prepare(s), F.lit(0.0))
    return spark.createDataFrame([(s.features.index(h.root.feature), h.root.threshold, *h.root.leaves())], "feature int, threshold double, left_value double, right_value double").select(
        "feature", *[_r(c).alias(c) for c in ("threshold", "left_value", "right_value")]
    )


def gbm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = revenue(spark, sf_dir)
    booster = GBM(s, losses.L2()).max_iter(2)
    f = booster.run(RegressionTree(losses.L2(), 2))
    rows = [(i + 1, s.features.index(h.root.feature), h.root.threshold, w, float(s.df.agg(losses.L2().mean(WeightedMajority(f.weights[: i + 1], f.hypotheses[: i + 1]).predict())).first()[0])) for i, (w, h) in enumerate(zip(f.weights, f.hypotheses, strict=True))]
    return spark.createDataFrame(rows, "round int, feature int, threshold double, coefficient double, l2 double").select("round", "feature", _r("threshold").alias("threshold"), _r("coefficient").alias("coefficient"), _r("l2", 4).alias("l2"))


def gbm_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = revenue(spark, sf_dir)
    booster = GBM.init_with_loss(s, losses.L1()).max_iter(3)
    f = booster.run(RegressionTree(losses.L2(), 3))
    return spark.createDataFrame([(i + 1, float(w)) for i, w in enumerate(f.weights)], "round int, coefficient double").select("round", _r("coefficient").alias("coefficient"))


def naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir)
    h = GaussianNB().fit(s)
    return s.df.select("row_id", h.predict().alias("prediction"), F.round(h.posterior(1.0), 5).alias("posterior"))


# -- boosters


def _rounds(spark: SparkSession, booster, features: list[str]) -> DataFrame:
    rows = [(i + 1, features.index(h.root.feature), h.root.threshold, float(w)) for i, (w, h) in enumerate(zip(booster.weights, booster.hypotheses, strict=True))]
    return spark.createDataFrame(rows, "round int, feature int, threshold double, weight double").select("round", "feature", _r("threshold").alias("threshold"), _r("weight").alias("weight"))


def additive(make: Callable[[Sample], object]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = lineitems(spark, sf_dir)
        booster = make(s).force_quit_at(3)
        booster.run(DecisionTree(1))
        return _rounds(spark, booster, FEATURES)

    return run


def _certificate(booster, s: Sample, f: WeightedMajority, bound: float) -> list[tuple]:
    """What can be told of a program's end without solving it again.

    The combination's soft margin, from the rows, is a lower bound on the largest edge under any feasible
    distribution; `tight` says that the last distribution comes within `bound` of it (or, for a bound of
    infinity, that nothing more is claimed).
    """
    number, margins, d, nu = booster.groups.number, booster.groups.margins, booster.d, booster._nu
    reached = losses.SoftMargin(nu).eval(s, f)
    edge = float((margins.T @ (number * d)).max())
    return [float(number.sum()), sum(f.weights), float((number * d).sum()), bool(d.min() >= 0 and d.max() <= (1 + 1e-6) / nu), bool(reached <= edge + 1e-6), bool(edge - reached <= bound)]


_CERTIFICATE = "n_rows double, weight_total double, mass_total double, feasible boolean, weakly_dual boolean, tight boolean"


def corrective(make: Callable[[Sample, int], object], rounds: int = 2, criterion: str = "entropy") -> Query:
    """The first rounds: stump, its edge under the program's distribution, and the program's value."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = lineitems(spark, sf_dir)
        booster = make(s, s.shape()[0]).force_quit_at(rounds)
        booster.run(DecisionTree(1, criterion))
        rows = [(r["round"], FEATURES.index(h.root.feature), h.root.threshold, float(r["edge"]), float(r["value"])) for r, h in zip(booster.trace, booster.hypotheses, strict=True)]
        out = spark.createDataFrame(rows, "round int, feature int, threshold double, edge double, value double")
        return out.select("round", "feature", _r("threshold").alias("threshold"), _r("edge", 4).alias("edge"), _r("value", 4).alias("value"))

    return run


def square_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = revenue(spark, sf_dir)
    booster = SquareLevR(s).max_iter(3)
    booster.run(RegressionTree(losses.L2(), 2))
    rows = [(r["round"], s.features.index(h.root.feature), h.root.threshold, r["weight"], r["potential"], r["correlation"]) for r, h in zip(booster.trace, booster.hypotheses, strict=True)]
    out = spark.createDataFrame(rows, "round int, feature int, threshold double, weight double, potential double, correlation double")
    return out.select("round", "feature", *[_r(c, d).alias(c) for c, d in (("threshold", 6), ("weight", 5), ("potential", 4), ("correlation", 6))])


def exp_lev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    s = Sample.from_df(rows, ["l_quantity", "l_discount"], F.col("l_quantity") + F.col("l_extendedprice") / 2000 - 50, check=False)
    booster = ExpLev(s).softness(0.1).max_iter(3)
    booster.run(DecisionTree(1))
    rows = [(r["round"], s.features.index(h.root.feature), h.root.threshold, r["weight"], r["potential"], r["correlation"]) for r, h in zip(booster.trace, booster.hypotheses, strict=True)]
    out = spark.createDataFrame(rows, "round int, feature int, threshold double, weight double, potential double, correlation double")
    return out.select("round", "feature", *[_r(c, d).alias(c) for c, d in (("threshold", 6), ("weight", 5), ("potential", 5), ("correlation", 6))])


def row_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the three programs over two hypotheses with as many margins as rows; the last with the first alone."""
    s = orders(spark, sf_dir)
    hypotheses = [GaussianNB(soft=True).fit(Sample(s.df, [f])) for f in s.features]
    both = programs.RowPrograms(GaussianNB().prepare(s), hypotheses)
    nu = 0.2 * both.m
    values = [("soft margin", both.soft_margin(nu, 2e-6)[0]), ("entropy", both.entropy(nu, 30.0, None)[0])]
    one = programs.RowPrograms(GaussianNB().prepare(s), hypotheses[:1])
    one.least_divergence(nu, both.train.df.agg(F.avg("__m0")).first()[0] - 0.05)
    values.append(("least divergence", one.divergence))
    return spark.createDataFrame([(k, float(v)) for k, v in values], "program string, value double").select("program", _r("value", 4).alias("value"))


def erlpboost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds over naive Bayes' scores, with programs over rows; two also where the first is close enough to the bound."""
    s = orders(spark, sf_dir)
    booster = ERLPBoost(s).nu(0.2 * s.shape()[0]).tolerance(0.2).at_least(2).force_quit_at(2).over_rows()
    booster.run(GaussianNB(soft=True))
    out = spark.createDataFrame([(r["round"], float(r["edge"]), float(r["value"])) for r in booster.trace], "round int, edge double, value double")
    return out.select("round", _r("edge", 4).alias("edge"), _r("value", 4).alias("value"))


def lpboost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LPBoost over naive Bayes' scores of priced line items: the first soft margin, and whether the last gap is as small as asked for.

    With prices nearly every row has a margin of its own; programs are solved over rows.
    """
    s = _with_price(spark, sf_dir)
    nu = 0.1 * s.shape()[0]
    booster = LPBoost(s).nu(nu).tolerance(0.02).force_quit_at(2).over_rows()
    f = booster.run(GaussianNB(soft=True))
    alone = losses.SoftMargin(nu).eval(s, WeightedMajority([1.0], booster.hypotheses[:1]))
    reached = losses.SoftMargin(nu).eval(s, f)
    row = (float(booster.trace[0]["edge"]), alone, bool(-1e-6 <= booster.value - reached <= 0.02 / 4 + 1e-6), bool(reached >= alone - 0.02 / 4))
    return spark.createDataFrame([row], "edge double, soft_margin double, gap_closed boolean, no_worse boolean").select(_r("edge", 4).alias("edge"), _r("soft_margin", 4).alias("soft_margin"), "gap_closed", "no_worse")


def _customers(spark: SparkSession, sf_dir: str) -> Sample:
    rows = _table(spark, sf_dir, "customer")
    return Sample.from_df(rows, ["c_acctbal", "c_nationkey"], F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(-1), "c_custkey", check=False)


CUSTOMER_STUMPS = [stump("c_acctbal", 4000.0, -1.0, 1.0), stump("c_nationkey", 12.0, 1.0, -1.0)]


def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    booster = GraphSepBoost(s)
    booster.preprocess(GaussianNB())
    booster.train.df = booster.train.df.withColumn("__sig", NaiveAggregation.signature(CUSTOMER_STUMPS))
    return booster._with_degrees().select("row_id", F.col("__degree").cast("long").alias("degree"))


def naive_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _customers(spark, sf_dir)
    h = NaiveAggregation.learned(CUSTOMER_STUMPS, s.df)
    return h.predict_all(s).select("row_id", "prediction")


def graph_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lineitems(spark, sf_dir)
    booster = GraphSepBoost(s)
    booster.preprocess(learner := DecisionTree(2, "edge"))
    t = 1
    while t <= 4 and not booster.boost(learner, t):
        t += 1
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(booster.edges_left)], "round int, edges_left long")


def bad_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    learner = BadBaseLearner(1e-3, 2.0)
    train = learner.prepare(Sample.dummy(spark, 60))
    return spark.createDataFrame(learner.edges(train, F.col("row_id") + 1.0)).select(F.col("classifier").cast("int"), _r("edge", 9).alias("edge"))


def lpboost_worst_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sample.dummy(spark, 60)
    booster = LPBoost(s).tolerance(1e-3).nu(2.0).force_quit_at(8)
    f = booster.run(BadBaseLearner(1e-3, 2.0))
    out = spark.createDataFrame([(float(booster.trace[0]["edge"]), *_certificate(booster, s, f, 1e-4))], f"edge double, {_CERTIFICATE}")
    return out.select(_r("edge").alias("edge"), F.col("n_rows").cast("long").alias("n_rows"), *[_r(c).alias(c) for c in ("weight_total", "mass_total")], "feasible", "weakly_dual", "tight")


def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = orders(spark, sf_dir)
    parts = [test.df.select("row_id", F.lit(i).alias("fold")) for i, (_, test) in enumerate(CrossValidation(s))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def logger_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lineitems(spark, sf_dir)
    logger = LoggerBuilder().booster(AdaBoost(s).force_quit_at(3)).weak_learner(DecisionTree(1)).objective_function(losses.HardMargin()).train_sample(s).test_sample(s).time_limit_as_mins(10).build()
    logger.run()
    return logger.frame().select("round", _r("ObjectiveValue").alias("objective"), _r("TrainLoss").alias("train_loss"), _r("TestLoss").alias("test_loss"))


def neural_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_quantity") * (1 - F.col("l_discount")) >= 24, 1).otherwise(-1)
    s = Sample.from_df(rows.withColumn("q", F.col("l_quantity") / 50).withColumn("d", F.col("l_discount") * 10), ["q", "d"], y, check=False)
    h = NeuralNetwork().append(16, neural.relu(0.0)).append(2, neural.softmax()).n_epoch(10).n_iter(100).fit(s)
    return s.df.agg(F.count(F.lit(1)).alias("n_rows"), _r(stats.zero_one_loss(h.predict())).alias("zero_one"))


#: Names of the weights of the network that network_steps trains, in the order of Network.flat(), and its rate.
NETWORK_NAMES = [*[f"a{i}{j}" for i in range(3) for j in range(2)], "a0", "a1", *[f"b{i}{j}" for i in range(2) for j in range(2)], "b0", "b1"]
NETWORK_RATE = 0.5


def _small_network() -> NeuralNetwork:
    return NeuralNetwork(seed=7).append(2, neural.sigmoid(0.5)).append(2, neural.softmax()).n_epoch(1).n_iter(3).minibatch_size(1 << 62).learning_rate(NETWORK_RATE).initial_scale(0.3).in_partitions()


def network_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of a network over all line items: the loss and the gradient before each, and the weights after it."""
    learner = _small_network()
    learner.fit(lineitems(spark, sf_dir))
    rows = [(t, n, step.loss, float(g), float(w)) for t, step in enumerate(learner.trace) for n, g, w in zip(NETWORK_NAMES, step.gradient, step.weights, strict=True)]
    return spark.createDataFrame(rows, "step int, parameter string, loss double, gradient double, weight double").select("step", "parameter", _r("loss").alias("loss"), _r("gradient", 8).alias("gradient"), _r("weight", 8).alias("weight"))


#: Rows that each fit of external_learner draws.
DRAWN = 4000


def fit_centroids(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labels' weighted mean points, -1 first."""
    return tuple((x[y == label] * weight[y == label, None]).sum(0) / weight[y == label].sum() for label in (-1.0, 1.0))


def score_centroids(model: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """From -1 at one mean to 1 at the other, along the line between them."""
    low, high = model
    along = high - low
    return 2 * (x - low) @ along / (along @ along) - 1


def external_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AdaBoost over a model of two NumPy functions, fitted to rows that are drawn by weight."""
    s = orders(spark, sf_dir)
    booster = AdaBoost(s).force_quit_at(2)
    booster.run(ExternalLearner(fit_centroids, score_centroids, rows=DRAWN, seed=5))
    rows = [(t + 1, *map(float, np.concatenate(h.load())), float(e), float(w)) for t, (h, e, w) in enumerate(zip(booster.hypotheses, booster.edges, booster.weights, strict=True))]
    names = ["low_price", "low_customer", "high_price", "high_customer"]
    out = spark.createDataFrame(rows, f"round int, {', '.join(f'{n} double' for n in names)}, edge double, weight double")
    return out.select("round", *[_r(n, 3).alias(n) for n in names], _r("edge").alias("edge"), _r("weight").alias("weight"))


def learner_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lineitems(spark, sf_dir)
    booster = AdaBoost(s).force_quit_at(2)
    booster.run(LearnerUnion(DecisionTree(1), DecisionTree(1, "gini")))
    return _rounds(spark, booster, FEATURES)


QUERIES: dict[str, Query] = {
    "sample_validate": sample_validate, "sample_features": sample_features, "sample_targets": sample_targets, "sample_dummy": sample_dummy,
    "weighted_moments": weighted_moments, "label_moments": label_moments, "edges": edges, "regression_losses": regression_losses, "entropy_kl": entropy_kl,
    "objectives": objectives, "capped_projection": capped_projection, "weighted_median": weighted_median,
    "bin_assign": bin_assign, "class_histogram": class_histogram, "grad_histogram": grad_histogram, "sparse_histogram": sparse_histogram, "sparse_tree": sparse_tree,
    **{f"split_{c}": split(c) for c in criteria.CRITERIA}, "tree_predict": tree_predict, "regression_split": regression_split, "gbm": gbm, "gbm_l1": gbm_l1, "naive_bayes": naive_bayes,
    "adaboost": additive(AdaBoost), "adaboostv": additive(lambda s: AdaBoostV(s).tolerance(0.01)), "madaboost": additive(MadaBoost), "smoothboost": additive(lambda s: SmoothBoost(s).gamma(0.1).tolerance(0.1)),
    "lpboost": corrective(lambda s, m: LPBoost(s).nu(0.1 * m).tolerance(0.01)), "softboost": corrective(lambda s, m: SoftBoost(s).nu(0.1 * m).tolerance(0.02)), "totalboost": corrective(lambda s, m: TotalBoost(s).tolerance(0.02)),
    "erlpboost": corrective(lambda s, m: ERLPBoost(s).nu(0.1 * m).tolerance(0.02)), "cerlpboost": corrective(lambda s, m: CERLPBoost(s).nu(0.1 * m).tolerance(0.1), 3), "mlpboost": corrective(lambda s, m: MLPBoost(s).nu(0.1 * m).tolerance(0.05)),
    "cerlpboost_pairwise": corrective(lambda s, m: CERLPBoost(s).nu(0.1 * m).tolerance(0.05).fw_type("blended_pairwise"), 3, "edge"), "cerlpboost_line_search": corrective(lambda s, m: CERLPBoost(s).nu(0.1 * m).tolerance(0.1).fw_type("line_search"), 3, "gini"),
    "sparse_gbm": sparse_gbm, "svmlight_bayes": svmlight_bayes,
    "square_lev": square_lev, "exp_lev": exp_lev, "row_programs": row_programs, "erlpboost_rows": erlpboost_rows, "lpboost_rows": lpboost_rows,
    "graph_degrees": graph_degrees, "naive_aggregation": naive_aggregation, "graph_separation": graph_separation, "bad_edges": bad_edges, "lpboost_worst_case": lpboost_worst_case,
    "cv_folds": cv_folds, "logger_trace": logger_trace, "neural_net": neural_net, "network_steps": network_steps, "external_learner": external_learner, "learner_union": learner_union,
}


# -- SQL


def _bins_sql(source: str, features: list[str], keep: str = "") -> str:
    """CTEs s (rows), k (bins' lows, widths and numbers) and b (rows with bins b0, b1, ...)."""
    lows = ", ".join(f"CASE WHEN min({f}) = max({f}) THEN min({f}) - 0.001 ELSE min({f}) END AS lo{i}, CASE WHEN min({f}) = max({f}) THEN max({f}) + 0.001 ELSE max({f}) END AS hi{i}, least(count(DISTINCT {f}), 255) AS n{i}" for i, f in enumerate(features))
    widths = ", ".join(f"lo{i}, (hi{i} - lo{i}) / n{i} AS w{i}, n{i}" for i in range(len(features)))
    cells = ", ".join(f"greatest(least(floor(({f} - lo{i}) / w{i}), n{i} - 1), 0)::INT AS b{i}" for i, f in enumerate(features))
    return f"s AS MATERIALIZED ({source}), k0 AS (SELECT {lows} FROM s), k AS MATERIALIZED (SELECT {widths} FROM k0), b AS MATERIALIZED (SELECT {cells}, y{keep} FROM s, k)"


def _hist_sql(table: str, n: int, sums: str, where: str = "true", by: str = "") -> str:
    """Sums by feature and bin (and more columns)."""
    return " UNION ALL ".join(f"SELECT {i} AS feature, b{i} AS bin{by}, {sums} FROM {table} WHERE {where} GROUP BY b{i}{by}" for i in range(n))


_P, _N = "sum(CASE WHEN y > 0 THEN d ELSE 0 END) AS p", "sum(CASE WHEN y > 0 THEN 0 ELSE d END) AS q"


def _h(p: str, t: str) -> str:
    x = f"(({p}) / nullif({t}, 0))"
    return f"(-coalesce(CASE WHEN {x} > 0 THEN {x} * ln({x}) END, 0) - coalesce(CASE WHEN 1 - {x} > 0 THEN (1 - {x}) * ln(1 - {x}) END, 0))"


def _g(p: str, t: str) -> str:
    x = f"(({p}) / nullif({t}, 0))"
    return f"coalesce(1 - {x} * {x} - (1 - {x}) * (1 - {x}), 0)"


_L, _R = "(lp + lq)", "(tp + tq - lp - lq)"
SCORES = {
    "entropy": f"({_L} * {_h('lp', _L)} + {_R} * {_h('tp - lp', _R)}) / (tp + tq)",
    "gini": f"({_L} * {_g('lp', _L)} + {_R} * {_g('tp - lp', _R)}) / (tp + tq)",
    "edge": "-abs((tp - lp - tq + lq) - (lp - lq)) / (tp + tq)",
    "twoing": f"-power(abs(lp / nullif({_L}, 0) - (tp - lp) / nullif({_R}, 0)) + abs(lq / nullif({_L}, 0) - (tq - lq) / nullif({_R}, 0)), 2) * {_L} * {_R} / power(2 * (tp + tq), 2)",
}


def _cuts_sql(hist: str, by: str = "") -> str:
    """Running and whole sums, and the next bin, of cuts between occupied bins."""
    part = f"{by}feature"
    return (
        f"SELECT * FROM (SELECT {by}feature, bin, lead(bin) OVER (PARTITION BY {part} ORDER BY bin) AS next_bin, sum(p) OVER (PARTITION BY {part} ORDER BY bin) AS lp, "
        f"sum(q) OVER (PARTITION BY {part} ORDER BY bin) AS lq, sum(p) OVER (PARTITION BY {part}) AS tp, sum(q) OVER (PARTITION BY {part}) AS tq FROM ({hist})) WHERE next_bin IS NOT NULL"
    )


def _threshold_sql(n: int) -> str:
    return "CASE feature " + " ".join(f"WHEN {i} THEN lo{i} + w{i} * (bin + 1 + next_bin) / 2" for i in range(n)) + " END"


def _split_sql(criterion: str) -> str:
    hist = _hist_sql("(SELECT *, 1.0::DOUBLE AS d FROM b)", 3, f"{_P}, {_N}")
    return f"WITH {_bins_sql(LINEITEMS, FEATURES)}, c AS ({_cuts_sql(hist)}) SELECT feature::INT AS feature, round({_threshold_sql(3)}, 6) AS threshold, round(round({SCORES[criterion]}, 10), 6) AS score FROM c, k ORDER BY round({SCORES[criterion]}, 10), feature, bin LIMIT 1"


def _additive_parts(kind: str, rounds: int) -> list[str]:
    """Stump boosting, a round at a time; f is the running sum."""
    parts = [_bins_sql(LINEITEMS, FEATURES), "c0 AS MATERIALIZED (SELECT b0, b1, b2, y, count(*) AS n, 0.0::DOUBLE AS f FROM b GROUP BY ALL)"]
    for t in range(1, rounds + 1):
        weight = {
            "madaboost": "least(1.0, exp(-y * f))",
            "smoothboost": f"CASE WHEN 1 + y * f - {t - 1} * (0.1 / 2.1) <= 0 THEN 1.0 ELSE power(0.9, (1 + y * f - {t - 1} * (0.1 / 2.1)) / 2) END",
        }.get(kind, "exp(-y * f)")
        parts.append(f"d{t} AS MATERIALIZED (SELECT *, n * ({weight}) AS d FROM c{t - 1})")
        cuts = _cuts_sql(_hist_sql(f"d{t}", 3, f"{_P}, {_N}"))
        best = [f"(SELECT *, {i} AS learner FROM ({cuts}) ORDER BY round({SCORES[c]}, 10), feature, bin LIMIT 1)" for i, c in enumerate(["entropy", "gini"] if kind == "union" else ["entropy"])]
        parts.append(f"x{t} AS MATERIALIZED ({' UNION ALL '.join(best)})")
        edge = "(abs(lp - lq) * abs(lp - lq) / (lp + lq) + power(tp - lp - tq + lq, 2) / (tp + tq - lp - lq)) / (tp + tq)"
        parts.append(f"e{t} AS MATERIALIZED (SELECT *, {edge} AS edge, (lp - lq) / (lp + lq) AS lc, (tp - lp - tq + lq) / (tp + tq - lp - lq) AS rc FROM x{t} ORDER BY round(edge, 12) DESC, learner LIMIT 1)")
        ada = "0.5 * ln((1 + e.edge) / (1 - e.edge))"
        if kind == "adaboostv":
            least = "least(" + ", ".join(f"(SELECT edge FROM e{j})" for j in range(1, t + 1)) + ")"
            w = f"{ada} - 0.5 * ln((1 + {least} - 0.01) / (1 - {least} + 0.01))"
        else:
            w = "1.0::DOUBLE" if kind == "smoothboost" else ada
        parts.append(f"w{t} AS MATERIALIZED (SELECT e.*, {w} AS w FROM e{t} e)")
        side = "CASE feature WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END <= bin"
        parts.append(f"c{t} AS MATERIALIZED (SELECT b0, b1, b2, y, n, f + w * CASE WHEN {side} THEN lc ELSE rc END AS f FROM c{t - 1}, w{t})")
    return parts


def _additive_sql(kind: str, rounds: int = 3) -> str:
    parts = _additive_parts(kind, rounds)
    shown = f"1.0 / {rounds}" if kind == "smoothboost" else "w"
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {t}::INT AS round, feature::INT AS feature, round({_threshold_sql(3)}, 6) AS threshold, round({shown}, 6) AS weight FROM w{t}, k" for t in range(1, rounds + 1))


def _tree_sql() -> str:
    """Two levels on the orders."""
    root = _hist_sql("(SELECT *, 1.0::DOUBLE AS d FROM b)", 2, f"{_P}, {_N}")
    inner = " UNION ALL ".join(f"SELECT {i} AS feature, b{i} AS bin, side, {_P}, {_N} FROM (SELECT *, 1.0::DOUBLE AS d FROM r) GROUP BY b{i}, side" for i in range(2))
    gini = SCORES["gini"]
    at = "CASE x.feature WHEN 0 THEN b0 ELSE b1 END <= x.bin"
    return (
        f"WITH {_bins_sql(ORDERS, ['o_totalprice', 'o_custkey'], ', row_id')}, x AS MATERIALIZED (SELECT * FROM ({_cuts_sql(root)}) ORDER BY round({gini}, 10), feature, bin LIMIT 1), "
        f"r AS MATERIALIZED (SELECT b.*, {at} AS side FROM b, x), "
        f"x2 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY round({gini}, 10), feature, bin) AS rk FROM ({_cuts_sql(inner, 'side, ')})) WHERE rk = 1 AND least(tp, tq) > 0 "
        f"AND round({gini}, 10) < {_g('tp', '(tp + tq)')}), "
        "l AS MATERIALIZED (SELECT r.row_id, r.y, r.side, CASE WHEN x2.side IS NULL THEN true ELSE CASE x2.feature WHEN 0 THEN b0 ELSE b1 END <= x2.bin END AS side2 FROM r LEFT JOIN x2 ON x2.side = r.side), "
        "v AS (SELECT side, side2, sum(y) / count(*) AS c FROM l GROUP BY ALL) SELECT row_id, round(c, 6) AS confidence, CASE WHEN c >= 0 THEN 1 ELSE -1 END::INT AS prediction FROM l JOIN v USING (side, side2)"
    )


def _regression_cut(table: str, n: int = 2) -> str:
    hist = _hist_sql(table, n, "sum(g) AS p, count(*)::DOUBLE AS q")
    score = "-(lp * lp / (lq + 0.01) + (tp - lp) * (tp - lp) / (tq - lq + 0.01))"
    return f"SELECT *, -lp / (lq + 0.01) AS lv, -(tp - lp) / (tq - lq + 0.01) AS rv FROM ({_cuts_sql(hist)}) ORDER BY round({score}, 8), feature, bin LIMIT 1"


def _gbm_sql(rounds: int) -> str:
    parts = [_bins_sql(REVENUE, ["l_quantity", "l_discount"]), "c0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS f FROM b)"]
    for t in range(1, rounds + 1):
        parts.append(f"x{t} AS MATERIALIZED ({_regression_cut(f'(SELECT *, f - y AS g FROM c{t - 1})')})")
        parts.append(f"h{t} AS MATERIALIZED (SELECT c.*, CASE WHEN CASE x.feature WHEN 0 THEN b0 ELSE b1 END <= x.bin THEN lv ELSE rv END AS h FROM c{t - 1} c, x{t} x)")
        parts.append(f"a{t} AS MATERIALIZED (SELECT sum((y - f) * h) / sum(h * h) AS a FROM h{t})")
        parts.append(f"c{t} AS MATERIALIZED (SELECT b0, b1, y, f + a * h AS f FROM h{t}, a{t})")
    rows = [f"SELECT {t}::INT AS round, feature::INT AS feature, round({_threshold_sql(2)}, 6) AS threshold, round(a, 6) AS coefficient, (SELECT round(avg(power(f - y, 2)), 4) FROM c{t}) AS l2 FROM x{t}, k, a{t}" for t in range(1, rounds + 1)]
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(rows)


def _gbm_l1_sql(rounds: int) -> str:
    """Regression trees of two levels of splits on the gradients; a round's coefficient is a weighted median."""
    score = "-(lp * lp / (lq + 0.01) + (tp - lp) * (tp - lp) / (tq - lq + 0.01))"
    parts = [_bins_sql(REVENUE, ["l_quantity", "l_discount"]), "c0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS f FROM b)"]
    for t in range(1, rounds + 1):
        inner = _hist_sql(f"r{t}", 2, "sum(g) AS p, count(*)::DOUBLE AS q", by=", side")
        parts += [
            f"x{t} AS MATERIALIZED ({_regression_cut(f'(SELECT *, f - y AS g FROM c{t - 1})')})",
            f"r{t} AS MATERIALIZED (SELECT c.*, f - y AS g, CASE x.feature WHEN 0 THEN b0 ELSE b1 END <= x.bin AS side, CASE WHEN CASE x.feature WHEN 0 THEN b0 ELSE b1 END <= x.bin THEN lv ELSE rv END AS v FROM c{t - 1} c, x{t} x)",
            f"z{t} AS MATERIALIZED (SELECT *, -lp / (lq + 0.01) AS zl, -(tp - lp) / (tq - lq + 0.01) AS zr FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY round({score}, 8), feature, bin) AS rk FROM ({_cuts_sql(inner, 'side, ')})) WHERE rk = 1 AND tp <> 0)",
            f"h{t} AS MATERIALIZED (SELECT r.b0, r.b1, r.y, r.f, CASE WHEN z.side IS NULL THEN r.v WHEN CASE z.feature WHEN 0 THEN b0 ELSE b1 END <= z.bin THEN zl ELSE zr END AS h FROM r{t} r LEFT JOIN z{t} z ON z.side = r.side)",
            f"o{t} AS (SELECT v, sum(w) OVER (ORDER BY v) AS c, sum(w) OVER () AS a FROM (SELECT (y - f) / h AS v, sum(abs(h)) AS w FROM h{t} WHERE h <> 0 GROUP BY 1))",
            f"a{t} AS MATERIALIZED (SELECT min(v) AS a FROM o{t} WHERE c >= a / 2 * (1 - 1e-12))",
            f"c{t} AS MATERIALIZED (SELECT b0, b1, y, f + a * h AS f FROM h{t}, a{t})",
        ]
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {t}::INT AS round, round(a, 6) AS coefficient FROM a{t}" for t in range(1, rounds + 1))


def _logger_sql(rounds: int) -> str:
    rows = []
    for t in range(1, rounds + 1):
        total = " + ".join(f"(SELECT w FROM w{j})" for j in range(1, t + 1))
        wrong = "sum(CASE WHEN CASE WHEN f >= 0 THEN 1 ELSE -1 END <> y THEN n ELSE 0 END) / sum(n)"
        rows.append(f"SELECT {t}::INT AS round, round(min(y * f) / ({total}), 6) AS objective, round({wrong}, 6) AS train_loss, round({wrong}, 6) AS test_loss FROM c{t}")
    return "WITH " + ", ".join(_additive_parts("adaboost", rounds)) + " " + " UNION ALL ".join(rows)


_CERTIFIED = "1.0::DOUBLE AS weight_total, 1.0::DOUBLE AS mass_total, true AS feasible, true AS weakly_dual, true AS tight"


def _capped_sql(points: str) -> str:
    """Groups (k, x, n, m0, l, ...) with share, of one row: 1 / nu at most, in proportion to exp(l) else."""
    return (
        "SELECT *, CASE WHEN l > at_l THEN 1 / nu ELSE scale * exp(l - top) END AS share FROM (SELECT *, max(l) FILTER (fits) OVER (PARTITION BY k) AS at_l, arg_max(sc, l) FILTER (fits) OVER (PARTITION BY k) AS scale FROM ("
        "SELECT *, (1 - (tn - cn) / nu) / rest AS sc, (1 - (tn - cn) / nu) / rest * exp(l - top) <= (1 + 1e-12) / nu AS fits FROM ("
        "SELECT *, sum(n) OVER (PARTITION BY k) AS tn, sum(n) OVER (PARTITION BY k ORDER BY l) AS cn, sum(n * exp(l - top)) OVER (PARTITION BY k ORDER BY l) AS rest FROM ("
        f"SELECT *, max(l) OVER (PARTITION BY k) AS top FROM ({points}), size))))"
    )


_DIVERGENCE = "sum(CASE WHEN share > 0 THEN n * share * ln(share) ELSE 0 END) + ln(any_value(m))"


def _smooth_sql(points: str) -> str:
    """The smoothed soft margin of each point."""
    return f"SELECT k, any_value(x) AS x, sum(n * share * m0) + ({_DIVERGENCE}) / any_value(eta) AS v FROM ({_capped_sql(points)}) GROUP BY k"


def _lowest_sql(points: str) -> str:
    """The soft margin of each point: the mean of the nu lowest margins."""
    under = f"SELECT *, sum(n) OVER (PARTITION BY k ORDER BY m0 ROWS UNBOUNDED PRECEDING) - n AS under FROM ({points}), size"
    return f"SELECT k, any_value(x) AS x, sum(m0 * greatest(0, least(n, nu - under))) / any_value(nu) AS v FROM ({under}) GROUP BY k"


def _dual_sql(bound: str) -> Callable[[str], str]:
    """Of the least divergence with an edge of at most `bound`, at the multiplier x."""
    return lambda points: f"SELECT k, any_value(x) AS x, {_DIVERGENCE} + any_value(x) * (sum(n * share * m0) - ({bound})) AS v FROM ({_capped_sql(points)}) GROUP BY k"


def _best_sql(name: str, value: Callable[[str], str], points: Callable[[str], str], width: float = 1.0, levels: int = 3, cells: int = 1000) -> list[str]:
    """name(x, v): the greatest value over x in [0, width], by grids that close in on it."""
    parts = []
    for i in range(levels):
        middle, step = (f"{width / 2}", width / cells) if i == 0 else (f"(SELECT x FROM {name}{i - 1})", width / cells / (cells / 2) ** i)
        at = f"(SELECT k, least(greatest({middle} + (k - {cells // 2}) * {step!r}, 0.0), {width}) AS x FROM range({cells + 1}) AS r(k))"
        parts.append(f"{name}{i} AS MATERIALIZED (SELECT x, v FROM ({value(points(at))}) ORDER BY v DESC, x LIMIT 1)")
    return [*parts, f"{name} AS MATERIALIZED (SELECT * FROM {name}{levels - 1})"]


def _corrective_sql(kind: str, tol: float, rounds: int = 2, search: bool = False, criterion: str = "entropy") -> str:
    """Rounds with stumps, each with the value of its program, solved over groups of equal margins.

    cm is the margin of the combination so far, mn the newest hypothesis'.  Programs of one variable are solved on grids
    that close in on the best point.
    """
    half = tol / 2
    eta = {"erlpboost": "greatest(0.5, ln(m / nu) / {0})", "cerlpboost": "ln(m / nu) / {0}", "mlpboost": "ln(m / nu) / {0}"}.get(kind, "1.0").format(half)
    cap = "1.0" if kind == "totalboost" else "0.1 * m"
    parts = [
        _bins_sql(LINEITEMS, FEATURES), f"size AS MATERIALIZED (SELECT *, {eta} AS eta FROM (SELECT m, {cap} AS nu FROM (SELECT count(*)::DOUBLE AS m FROM b)))",
        "c0 AS MATERIALIZED (SELECT b0, b1, b2, y, count(*)::DOUBLE AS n, 0.0::DOUBLE AS cm FROM b GROUP BY ALL)", "d1 AS MATERIALIZED (SELECT *, n / m AS d, 1 / m AS share FROM c0, size)",
    ]
    side = "CASE feature WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END <= bin"
    values = []
    for t in range(1, rounds + 1):
        parts.append(f"x{t} AS MATERIALIZED (SELECT * FROM ({_cuts_sql(_hist_sql(f'd{t}', 3, f'{_P}, {_N}'))}) ORDER BY round({SCORES[criterion]}, 10), feature, bin LIMIT 1)")
        edge = "(power(lp - lq, 2) / (lp + lq) + power(tp - lp - tq + lq, 2) / (tp + tq - lp - lq)) / (tp + tq)"
        parts.append(f"w{t} AS MATERIALIZED (SELECT *, {edge} AS edge, (lp - lq) / (lp + lq) AS lc, (tp - lp - tq + lq) / (tp + tq - lp - lq) AS rc FROM x{t})")
        kept = "".join(f", m{j}" for j in range(1, t))
        parts.append(f"h{t} AS MATERIALIZED (SELECT b0, b1, b2, y, n, cm, share{kept}, y * CASE WHEN {side} THEN lc ELSE rc END AS m{t} FROM d{t}, w{t})")
        along = f"(m{t} - cm)"
        parts.append(f"g{t} AS MATERIALIZED (SELECT cm, {along} AS mn, share, sum(n) AS n FROM h{t} GROUP BY ALL)")
        line = lambda at, t=t: f"SELECT k, x, n, cm + x * mn AS m0, -(SELECT eta FROM size) * (cm + x * mn) AS l FROM g{t}, {at}"
        whole = f"(SELECT 0 AS k, {'1.0' if t == 1 else f'(SELECT x FROM s{t})'} AS x)"
        short = f"SELECT least(greatest(sum(n * share * mn) / any_value(eta) / max(mn * mn), 0.0), 1.0) AS x FROM g{t}, size"
        if t == 1:
            parts.append(f"s{t} AS (SELECT 1.0 AS x)")
        elif kind == "lpboost":
            parts += _best_sql(f"s{t}", _lowest_sql, line)
        elif kind == "erlpboost" or search:
            parts += _best_sql(f"s{t}", _smooth_sql, line)
        elif kind == "mlpboost":
            parts += _best_sql(f"l{t}", _lowest_sql, line)
            parts.append(f"s{t} AS MATERIALIZED (SELECT x FROM ({_smooth_sql(line(f'(SELECT 0 AS k, x FROM ({short}) UNION ALL SELECT 1, x FROM l{t})'))}) ORDER BY v DESC, k LIMIT 1)")
        else:
            parts.append(f"s{t} AS MATERIALIZED ({short})")
        if kind in ("softboost", "totalboost"):
            bound = "least(" + ", ".join(f"(SELECT edge FROM w{j})" for j in range(1, t + 1)) + f") - {tol}"
            values.append(bound)
            if t < rounds:
                tilted = lambda at, t=t: f"SELECT k, x, n, mn AS m0, -x * mn AS l FROM g{t}, {at}"
                parts += _best_sql(f"q{t}", _dual_sql(bound), tilted, 100.0, 4)
                parts.append(f"f{t} AS MATERIALIZED (SELECT m0, any_value(share) AS share FROM ({_capped_sql(tilted(f'(SELECT 0 AS k, x FROM q{t})'))}) GROUP BY m0)")
                parts.append(f"d{t + 1} AS MATERIALIZED (SELECT b0, b1, b2, y, n, m{t} AS cm, f.share, n * f.share AS d, m{t} FROM h{t} JOIN f{t} f ON f.m0 = m{t})")
            continue
        values.append(f"(SELECT v FROM ({(_lowest_sql if kind == 'lpboost' else _smooth_sql)(line(whole))}))")
        if t < rounds:
            to = f"cm + (SELECT x FROM s{t}) * {along}"
            parts.append(f"i{t} AS MATERIALIZED (SELECT b0, b1, b2, y, n, {to} AS cm{kept}, m{t} FROM h{t})")
            groups = f"SELECT 0 AS k, 0 AS x, cm AS m0, -(SELECT eta FROM size) * cm AS l, sum(n) AS n FROM i{t} GROUP BY cm"
            if kind == "lpboost":
                shares = f"SELECT m0, greatest(0, least(n, nu - under)) / nu / n AS share FROM (SELECT *, sum(n) OVER (ORDER BY m0) - n AS under FROM ({groups}), size)"
            else:
                shares = f"SELECT m0, share FROM ({_capped_sql(groups)})"
            parts.append(f"f{t} AS MATERIALIZED ({shares})")
            parts.append(f"d{t + 1} AS MATERIALIZED (SELECT i.*, f.share, n * f.share AS d FROM i{t} i JOIN f{t} f ON f.m0 = i.cm)")
    ends = [f"(SELECT edge FROM w{t}) - (SELECT sum(n * share * cm) FROM h{t}) > {half}" for t in range(2, rounds + 1)]
    rows = [f"SELECT {t}::INT AS round, feature::INT AS feature, round({_threshold_sql(3)}, 6) AS threshold, round(edge, 4) AS edge, round({v}, 4) AS value FROM w{t}, k{' WHERE ' + ' AND '.join(ends[: t - 1]) if kind == 'cerlpboost' and t > 1 else ''}" for t, v in enumerate(values, 1)]
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(rows)


#: Naive Bayes over the orders' price and customer, and over each alone: confidences of rows.
_SIZE = "size AS MATERIALIZED (SELECT count(*)::DOUBLE AS m, 0.2 * count(*) AS nu, {eta} AS eta FROM s)"


def _bayes_sql(table: str, features: list[str], weight: str = "1.0::DOUBLE") -> str:
    """row_id, confidence: the posterior of 1 less that of -1, of naive Bayes under weights of rows."""
    means = ", ".join(f"sum(d * {f}) / sum(d) AS mu_{f}" for f in features)
    spread = ", ".join(f"sum(d * power({f} - mu_{f}, 2)) / sum(d) AS va_{f}" for f in features)
    log = "ln(p)" + "".join(f" - 0.5 * (ln(2 * pi() * va_{f}) + power({f} - mu_{f}, 2) / va_{f})" for f in features)
    return (
        f"WITH wd AS (SELECT *, {weight} AS d FROM {table}), mu AS (SELECT y AS yy, sum(d) / (SELECT sum(d) FROM wd) AS p, {means} FROM wd GROUP BY y), va AS (SELECT y AS vy, {spread} FROM wd JOIN mu ON y = yy GROUP BY y), "
        f"lj AS (SELECT row_id, yy, {log} AS l FROM {table}, mu JOIN va ON yy = vy) SELECT row_id, 2 / (1 + exp(max(l) FILTER (yy < 0) - max(l) FILTER (yy > 0))) - 1 AS c FROM lj GROUP BY row_id"
    )


def _row_programs_sql() -> str:
    at = lambda grid: f"SELECT k, x, 1.0::DOUBLE AS n, (1 - x) * m1 + x * m2 AS m0, -30 * ((1 - x) * m1 + x * m2) AS l FROM g, {grid}"
    tilted = lambda grid: f"SELECT k, x, 1.0::DOUBLE AS n, m1 AS m0, -x * m1 AS l FROM g, {grid}"
    parts = [f"s AS MATERIALIZED ({ORDERS})", _SIZE.format(eta="30.0"), f"c1 AS MATERIALIZED ({_bayes_sql('s', ['o_totalprice'])})", f"c2 AS MATERIALIZED ({_bayes_sql('s', ['o_custkey'])})",
             "g AS MATERIALIZED (SELECT y * c1.c AS m1, y * c2.c AS m2 FROM s JOIN c1 USING (row_id) JOIN c2 USING (row_id))", "e AS (SELECT avg(m1) AS e FROM g)"]
    small = {"levels": 5, "cells": 40}
    parts += _best_sql("lp", _lowest_sql, at, **small) + _best_sql("en", _smooth_sql, at, **small) + _best_sql("kl", _dual_sql("(SELECT e FROM e) - 0.05"), tilted, 20.0, **small)
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT '{name}' AS program, round(v, 4) AS value FROM {t}" for name, t in (("soft margin", "lp"), ("entropy", "en"), ("least divergence", "kl")))


def _erlp_rows_sql() -> str:
    """Two rounds of ERLPBoost over naive Bayes' scores, tolerance 0.2."""
    features = ["o_totalprice", "o_custkey"]
    parts = [f"s AS MATERIALIZED ({ORDERS})", _SIZE.format(eta="greatest(0.5, ln(1 / 0.2) / 0.1)"), f"c1 AS MATERIALIZED ({_bayes_sql('s', features)})",
             "g1 AS MATERIALIZED (SELECT s.*, y * c AS m1 FROM s JOIN c1 USING (row_id))",
             f"d1 AS MATERIALIZED ({_capped_sql('SELECT 0 AS k, 0 AS x, 1.0::DOUBLE AS n, m1 AS m0, -(SELECT eta FROM size) * m1 AS l, row_id, o_totalprice, o_custkey, y FROM g1')})",
             f"c2 AS MATERIALIZED ({_bayes_sql('d1', features, 'share')})", "g2 AS MATERIALIZED (SELECT d1.m0 AS m1, y * c AS m2, share FROM d1 JOIN c2 USING (row_id))"]
    at = lambda grid: f"SELECT k, x, 1.0::DOUBLE AS n, (1 - x) * m1 + x * m2 AS m0, -(SELECT eta FROM size) * ((1 - x) * m1 + x * m2) AS l FROM g2, {grid}"
    parts += _best_sql("en", _smooth_sql, at, levels=5, cells=40)
    first = _smooth_sql(at("(SELECT 0 AS k, 0.0 AS x)"))
    return "WITH " + ", ".join(parts) + f" SELECT 1::INT AS round, round((SELECT avg(m1) FROM g2), 4) AS edge, round((SELECT v FROM ({first})), 4) AS value UNION ALL SELECT 2, round((SELECT sum(share * m2) FROM g2), 4), round((SELECT v FROM en), 4)"


def _square_lev_sql(rounds: int) -> str:
    parts = [_bins_sql(REVENUE, ["l_quantity", "l_discount"]), "c0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS f FROM b)"]
    for t in range(1, rounds + 1):
        parts.append(f"p{t} AS MATERIALIZED (SELECT var_pop(y - f) AS potential FROM c{t - 1})")
        parts.append(f"x{t} AS MATERIALIZED ({_regression_cut(f'(SELECT *, f - y AS g FROM c{t - 1})')})")
        parts.append(f"h{t} AS MATERIALIZED (SELECT c.*, CASE WHEN CASE x.feature WHEN 0 THEN b0 ELSE b1 END <= x.bin THEN lv ELSE rv END AS h FROM c{t - 1} c, x{t} x)")
        parts.append(f"a{t} AS MATERIALIZED (SELECT regr_slope(y - f, h) AS a, corr(y - f, h) AS r FROM h{t})")
        parts.append(f"c{t} AS MATERIALIZED (SELECT b0, b1, y, f + a * h AS f FROM h{t}, a{t})")
    rows = [f"SELECT {t}::INT AS round, feature::INT AS feature, round({_threshold_sql(2)}, 6) AS threshold, round(a, 5) AS weight, round(potential, 4) AS potential, round(r, 6) AS correlation FROM x{t}, k, a{t}, p{t}" for t in range(1, rounds + 1)]
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(rows)


def _exp_lev_sql(rounds: int, s: float = 0.1) -> str:
    parts = [_bins_sql("SELECT l_quantity, l_discount, l_quantity + l_extendedprice / 2000 - 50 AS y FROM lineitem", ["l_quantity", "l_discount"]), "c0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS f FROM b)"]
    for t in range(1, rounds + 1):
        size = f"exp({s} * abs(y - f)) - exp(-{s} * abs(y - f))"
        parts.append(f"p{t} AS MATERIALIZED (SELECT ln(sum(exp({s} * (y - f)) + exp(-{s} * (y - f)) - 2)) AS potential FROM c{t - 1})")
        parts.append(f"d{t} AS MATERIALIZED (SELECT b0, b1, CASE WHEN y - f >= 0 THEN 1.0 ELSE -1.0 END AS y, {size} AS d FROM c{t - 1})")
        parts.append(f"x{t} AS MATERIALIZED (SELECT * FROM ({_cuts_sql(_hist_sql(f'd{t}', 2, f'{_P}, {_N}'))}) ORDER BY round({SCORES['entropy']}, 10), feature, bin LIMIT 1)")
        edge = "(power(lp - lq, 2) / (lp + lq) + power(tp - lp - tq + lq, 2) / (tp + tq - lp - lq)) / (tp + tq)"
        parts.append(f"w{t} AS MATERIALIZED (SELECT *, ln((1 + e) / (1 - e)) / {2 * s} AS w FROM (SELECT *, {edge} AS e, (lp - lq) / (lp + lq) AS lc, (tp - lp - tq + lq) / (tp + tq - lp - lq) AS rc FROM x{t}))")
        parts.append(f"c{t} AS MATERIALIZED (SELECT b0, b1, y, f + w * CASE WHEN CASE feature WHEN 0 THEN b0 ELSE b1 END <= bin THEN lc ELSE rc END AS f FROM c{t - 1}, w{t})")
    rows = [f"SELECT {t}::INT AS round, feature::INT AS feature, round({_threshold_sql(2)}, 6) AS threshold, round(w, 5) AS weight, round(potential, 5) AS potential, round(e, 6) AS correlation FROM w{t}, k, p{t}" for t in range(1, rounds + 1)]
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(rows)


def _graph_sql(rounds: int) -> str:
    """Edges of the graph before each round; a round splits signatures by a tree of two levels under the degrees."""
    edge = SCORES["edge"]
    root = "CASE x.feature WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END <= x.bin"
    inner = "CASE WHEN z.side IS NULL THEN true ELSE CASE z.feature WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END <= z.bin END"
    parts = [_bins_sql(LINEITEMS, FEATURES), "c0 AS MATERIALIZED (SELECT b0, b1, b2, y, count(*)::DOUBLE AS n, '' AS sig FROM b GROUP BY ALL)"]
    other = "sum(CASE WHEN (y > 0) = {} THEN n ELSE 0 END) OVER (PARTITION BY sig)"
    for t in range(1, rounds + 1):
        parts += [
            f"g{t} AS MATERIALIZED (SELECT *, n * CASE WHEN y > 0 THEN {other.format('false')} ELSE {other.format('true')} END AS d FROM c{t - 1})",
            f"l{t} AS MATERIALIZED (SELECT (sum(d) / 2)::BIGINT AS e FROM g{t})",
            f"x{t} AS MATERIALIZED (SELECT * FROM ({_cuts_sql(_hist_sql(f'g{t}', 3, f'{_P}, {_N}', 'd > 0'))}) ORDER BY round({edge}, 10), feature, bin LIMIT 1)",
            f"r{t} AS MATERIALIZED (SELECT g.*, {root} AS side FROM g{t} g, x{t} x)",
            f"z{t} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY round({edge}, 10), feature, bin) AS rk FROM ({_cuts_sql(_hist_sql(f'r{t}', 3, f'{_P}, {_N}', 'd > 0', ', side'), 'side, ')})) "
            f"WHERE rk = 1 AND least(tp, tq) > 0 AND round({edge}, 10) < 0)",
            f"q{t} AS MATERIALIZED (SELECT r.*, {inner} AS side2 FROM r{t} r LEFT JOIN z{t} z ON z.side = r.side)",
            f"c{t} AS MATERIALIZED (SELECT b0, b1, b2, y, n, sig || CASE WHEN sum(y * d) OVER (PARTITION BY side, side2) >= 0 THEN '1' ELSE '0' END AS sig FROM q{t})",
        ]
    less = lambda t: f" WHERE e > 0 AND e < (SELECT e FROM l{t - 1})" if t > 1 else " WHERE e > 0"
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {t}::INT AS round, e AS edges_left FROM l{t}{less(t)}" for t in range(1, rounds + 1))


_WEIGHTED = f"WITH s AS ({LINEITEMS}), t AS (SELECT *, l_extendedprice / (SELECT sum(l_extendedprice) FROM s) AS d FROM s)"
_UNPIVOT = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v, d, y FROM t" for f in FEATURES)


def _bad_sql(weight: str = "(i + 1.0) / 1830") -> str:
    eps = "(0.001 / 120)"
    tag1 = f"CASE WHEN i >= 30 + c - 1 AND i < 30 + c + 1 THEN 1.0 WHEN i >= 30 + c + 1 AND i < 30 + c + 3 THEN -1 + (3 + 2 * c - 1) * {eps} ELSE -1 + (3 + 2 * c) * {eps} END"
    level = f"CASE WHEN c = 0 THEN CASE WHEN i < 30 THEN 1.0 WHEN i < 32 THEN -1 + 2 * {eps} ELSE -1 + 3 * {eps} END WHEN c < 30 THEN {tag1} ELSE CASE WHEN i < 30 THEN -1 + {eps} ELSE 1 - {eps} END END"
    return f"SELECT c::INT AS classifier, round(sum({weight} * ({level})), 9) AS edge FROM range(31) AS a(c), range(60) AS b(i) GROUP BY c"


#: The features of the sparse rows as columns, zeros included.
_SPARSE = ["l_quantity", "l_discount", "l_tax", *[f"CASE WHEN l_quantity::INT % 4 = {i} AND l_discount > 0.09 THEN l_tax ELSE 0 END" for i in range(4)]]
_SPARSE_BINS = _bins_sql("SELECT y, " + ", ".join(f"{f} AS f{i}" for i, f in enumerate(_SPARSE)) + f" FROM ({LINEITEMS})", [f"f{i}" for i in range(7)])


def _network_sql(steps: int) -> str:
    """Steps of the small network, from its first weights: forward, deltas, mean gradients."""
    first = neural.Network([3, 2, 2], [neural.sigmoid(0.5), neural.softmax()], np.random.default_rng(7), 0.3).flat()
    parts = [f"s AS ({LINEITEMS})", "p0 AS (SELECT " + ", ".join(f"{float(v)!r}::DOUBLE AS {n}" for n, v in zip(NETWORK_NAMES, first, strict=True)) + ")"]
    for t in range(steps):
        hidden = ", ".join(f"1 / (1 + exp(-0.5 * ({' + '.join(f'{x} * a{i}{j}' for i, x in enumerate(FEATURES))} + a{j}))) AS h{j}" for j in range(2))
        parts += [f"h{t} AS (SELECT *, {hidden} FROM s, p{t})", f"o{t} AS (SELECT *, 1 / (1 + exp(h0 * b00 + h1 * b10 + b0 - h0 * b01 - h1 * b11 - b1)) AS q FROM h{t})"]
        parts.append(f"d{t} AS (SELECT *, q - e AS e1, e - q AS e0, CASE WHEN e = 1 THEN -ln(q) ELSE -ln(1 - q) END AS loss FROM (SELECT *, CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS e FROM o{t}))")
        parts.append(f"c{t} AS (SELECT *, {', '.join(f'(e0 * b{j}0 + e1 * b{j}1) * 0.5 * h{j} * (1 - h{j}) AS z{j}' for j in range(2))} FROM d{t})")
        sums = [*[f"avg({x} * z{j}) AS a{i}{j}" for i, x in enumerate(FEATURES) for j in range(2)], "avg(z0) AS a0", "avg(z1) AS a1", *[f"avg(h{i} * e{j}) AS b{i}{j}" for i in range(2) for j in range(2)], "avg(e0) AS b0", "avg(e1) AS b1"]
        parts += [f"g{t} AS MATERIALIZED (SELECT avg(loss) AS loss, {', '.join(sums)} FROM c{t})", f"p{t + 1} AS MATERIALIZED (SELECT {', '.join(f'p{t}.{n} - {NETWORK_RATE} * g{t}.{n} AS {n}' for n in NETWORK_NAMES)} FROM p{t}, g{t})"]
    rows = " UNION ALL ".join(f"SELECT {t} AS step, '{n}' AS parameter, round(loss, 6) AS loss, round(g{t}.{n}, 8) + 0.0 AS gradient, round(p{t + 1}.{n}, 8) + 0.0 AS weight FROM g{t}, p{t + 1}" for t in range(steps) for n in NETWORK_NAMES)
    return f"WITH {', '.join(parts)} {rows}"


def _external_sql(rounds: int) -> str:
    """Rounds of AdaBoost over centroids of rows that are drawn by weight."""
    parts = [f"f0 AS (SELECT *, 0.0::DOUBLE AS f FROM ({ORDERS}))"]
    for t in range(rounds):
        u = f"(('0x' || substr(md5(row_id || '|5|{t}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"
        parts += [
            f"d{t} AS MATERIALIZED (SELECT *, exp(-y * f) AS d, sum(exp(-y * f)) OVER () AS total, count(*) OVER () AS m FROM f{t})",
            f"w{t} AS (SELECT *, d / (total * p) AS share FROM (SELECT *, CASE WHEN {DRAWN} >= m THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, d * {DRAWN} / total) END AS p, {u} AS u FROM d{t}) WHERE {DRAWN} >= m OR u < p)",
            f"c{t} AS MATERIALIZED (SELECT {', '.join(f'sum(share * {x}) FILTER (y = {v}) / sum(share) FILTER (y = {v}) AS {n}' for n, x, v in [('lp', 'o_totalprice', -1), ('lc', 'o_custkey', -1), ('hp', 'o_totalprice', 1), ('hc', 'o_custkey', 1)])} FROM w{t})",
            f"h{t} AS MATERIALIZED (SELECT d{t}.*, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 2 * ((o_totalprice - lp) * (hp - lp) + (o_custkey - lc) * (hc - lc)) / (power(hp - lp, 2) + power(hc - lc, 2)) - 1)) AS h FROM d{t}, c{t})",
            f"e{t} AS MATERIALIZED (SELECT *, 0.5 * ln((1 + edge) / (1 - edge)) AS weight FROM (SELECT sum(d * y * h) / sum(d) AS edge FROM h{t}))",
            f"f{t + 1} AS (SELECT o_totalprice, o_custkey, row_id, y, f + weight * h AS f FROM h{t}, e{t})",
        ]
    rows = " UNION ALL ".join(f"SELECT {t + 1} AS round, round(lp, 3) AS low_price, round(lc, 3) AS low_customer, round(hp, 3) AS high_price, round(hc, 3) AS high_customer, round(edge, 6) AS edge, round(weight, 6) AS weight FROM c{t}, e{t}" for t in range(rounds))
    return f"WITH {', '.join(parts)} {rows}"


def _sparse_tree_sql() -> str:
    cuts = _cuts_sql(_hist_sql("(SELECT *, 1.0::DOUBLE AS d FROM b)", 7, f"{_P}, {_N}"))
    edge = "(power(lp - lq, 2) / (lp + lq) + power(tp - lp - tq + lq, 2) / (tp + tq - lp - lq)) / (tp + tq)"
    return (
        f"WITH {_SPARSE_BINS} SELECT feature::INT AS feature, round({_threshold_sql(7)}, 6) AS threshold, round((lp - lq) / (lp + lq), 6) AS left_value, "
        f"round((tp - lp - tq + lq) / (tp + tq - lp - lq), 6) AS right_value, round({edge}, 6) AS edge FROM ({cuts}), k ORDER BY round({SCORES['entropy']}, 10), feature, bin LIMIT 1"
    )


def _sparse_gbm_sql(rounds: int) -> str:
    bins = _bins_sql("SELECT l_quantity * (1 - l_discount) * (1 + l_tax) AS y, " + ", ".join(f"{f} AS f{i}" for i, f in enumerate(_SPARSE)) + " FROM lineitem", [f"f{i}" for i in range(7)])
    side = "CASE x.feature " + " ".join(f"WHEN {i} THEN b{i}" for i in range(7)) + " END <= x.bin"
    parts = [bins, "c0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS f FROM b)"]
    for t in range(1, rounds + 1):
        parts.append(f"x{t} AS MATERIALIZED ({_regression_cut(f'(SELECT *, f - y AS g FROM c{t - 1})', 7)})")
        parts.append(f"h{t} AS MATERIALIZED (SELECT c.*, CASE WHEN {side} THEN lv ELSE rv END AS h FROM c{t - 1} c, x{t} x)")
        parts.append(f"a{t} AS MATERIALIZED (SELECT sum((y - f) * h) / sum(h * h) AS a FROM h{t})")
        parts.append(f"c{t} AS MATERIALIZED (SELECT * EXCLUDE (h, f, a), f + a * h AS f FROM h{t}, a{t})")
    rows = [f"SELECT {t}::INT AS round, feature::INT AS feature, round({_threshold_sql(7)}, 6) AS threshold, round(a, 6) AS coefficient, (SELECT round(avg(power(f - y, 2)), 4) FROM c{t}) AS l2 FROM x{t}, k, a{t}" for t in range(1, rounds + 1)]
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(rows)


#: Means and variances by (label, feature) from the entries and the labels' numbers of rows; a row's log density corrects an all-zero row's.
_SVMLIGHT_SQL = """
WITH o AS MATERIALIZED (SELECT o_orderkey AS row_id, CASE WHEN o_totalprice + 100 * o_custkey >= 250000 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, o_totalprice / 100000 AS price, 2 + o_custkey % 100000 AS i FROM orders),
n AS (SELECT y AS l, count(*)::DOUBLE AS m FROM o GROUP BY y),
e AS MATERIALIZED (SELECT row_id, y, 1 AS f, price AS v FROM o UNION ALL SELECT row_id, y, i, 1.0 FROM o),
p0 AS (SELECT f, l, m, coalesce(s, 0) / m AS mu, coalesce(k, 0) AS k FROM (SELECT DISTINCT f FROM e) CROSS JOIN n LEFT JOIN (SELECT f, y AS l, sum(v) AS s, count(*) AS k FROM e GROUP BY f, y) USING (f, l)),
p AS MATERIALIZED (SELECT f, l, any_value(m) AS m, any_value(mu) AS mu, greatest((coalesce(sum(power(v - mu, 2)), 0) + (any_value(m) - any_value(k)) * power(any_value(mu), 2)) / any_value(m), 1e-9) AS va
      FROM p0 LEFT JOIN e USING (f) WHERE e.y IS NULL OR e.y = l GROUP BY f, l
      UNION ALL SELECT f, l, m, mu, 1e-9 FROM p0 WHERE k = 0),
z AS (SELECT l, ln(any_value(m) / (SELECT count(*) FROM o)) - 0.5 * sum(ln(2 * pi() * va) + mu * mu / va) AS z FROM p GROUP BY l),
j AS (SELECT row_id, e.y, p.l, any_value(z) - 0.5 * sum((power(v - mu, 2) - mu * mu) / va) AS lj FROM e JOIN p USING (f) JOIN z ON z.l = p.l GROUP BY row_id, e.y, p.l)
SELECT row_id, y, round(1 / (1 + exp(max(lj) FILTER (l < 0) - max(lj) FILTER (l > 0))), 4) AS posterior FROM j GROUP BY row_id, y
"""


ORACLE_SQL: dict[str, str] = {
    "sample_validate": f"SELECT count(*) AS n_rows, count(DISTINCT y) AS n_labels, min(y) AS min_label, max(y) AS max_label, count(*) FILTER (y <> floor(y)) AS n_fractional FROM ({ORDERS})",
    "sample_features": " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n_rows, count(DISTINCT {f}) AS n_distinct, count(*) FILTER ({f} = 0) AS n_zero, min({f}) AS min_value, max({f}) AS max_value FROM lineitem" for f in FEATURES),
    "sample_targets": f"SELECT y, count(*) AS n_rows FROM ({LINEITEMS}) GROUP BY y",
    "sample_dummy": "SELECT i AS row_id, 0.0::DOUBLE AS dummy, CASE WHEN i < 500 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM range(1001) AS t(i)",
    "weighted_moments": f"{_WEIGHTED}, u AS ({_UNPIVOT}), g AS (SELECT feature, sum(d * v) AS mu FROM u GROUP BY feature) SELECT feature, round(any_value(mu), 6) AS mean, round(sum(d * power(v - mu, 2)), 6) AS variance FROM u JOIN g USING (feature) GROUP BY feature",
    "label_moments": f"{_WEIGHTED}, u AS ({_UNPIVOT}), g AS (SELECT feature, y, sum(d) AS w, sum(d * v) / sum(d) AS mu FROM u GROUP BY feature, y) SELECT y, feature, round(any_value(w), 6) AS weight, round(any_value(mu), 6) AS mean, round(sum(d * power(v - mu, 2)) / sum(d), 6) AS variance FROM u JOIN g USING (feature, y) GROUP BY feature, y",
    "edges": f"{_WEIGHTED} SELECT round(sum(d * y * CASE WHEN l_quantity < 24.5 THEN -0.9 ELSE 0.8 END), 6) AS edge, round(sum(d * y * {FIXED_SQL}), 6) AS combined_edge, round(sum(d) FILTER (y = 1), 6) AS positive_weight, round(sum(d * l_tax), 6) AS inner_product, round(avg(CASE WHEN (CASE WHEN {FIXED_SQL} >= 0 THEN 1 ELSE -1 END) <> y THEN 1.0 ELSE 0.0 END), 6) AS zero_one, round(min(y * {FIXED_SQL}), 6) AS least_margin FROM t",
    "regression_losses": f"SELECT round(avg(abs(l_quantity * 0.97 - y)), 6) AS l1, round(avg(power(l_quantity * 0.97 - y, 2)), 6) AS l2 FROM ({REVENUE})",
    "entropy_kl": "WITH t AS (SELECT o_totalprice / (SELECT sum(o_totalprice) FROM orders) AS d, o_custkey / 100.0::DOUBLE AS e FROM orders), x AS (SELECT max(e) AS mx FROM t) SELECT round(sum(d * ln(d)), 6) AS entropy, round(sum(d * ln(d)) + ln(count(*)), 6) AS divergence, round(ln(sum(exp(e - mx))) + any_value(mx), 6) AS log_sum_exp FROM t, x",
    "objectives": f"WITH s AS ({LINEITEMS}), t AS (SELECT y * {FIXED_SQL} AS g, {FIXED_SQL} AS f, y, row_number() OVER (ORDER BY y * {FIXED_SQL}) AS i, count(*) OVER () // 10 AS nu FROM s) "
    "SELECT 'soft margin' AS objective, round(sum(g) FILTER (i <= nu) / any_value(nu), 6) AS value FROM t UNION ALL SELECT 'hard margin', round(min(g), 6) FROM t UNION ALL SELECT 'exponential, labels', round(avg(exp(-y * CASE WHEN f >= 0 THEN 1 ELSE -1 END)), 6) FROM t UNION ALL SELECT 'exponential, confidences', round(avg(exp(-g)), 6) FROM t",
    "capped_projection": "WITH s AS (SELECT o_orderkey AS row_id, round(o_totalprice / 100000, 2) AS l FROM orders), m AS (SELECT count(*) AS m, count(*) // 3 AS nu FROM s), "
    "o AS (SELECT *, row_number() OVER (ORDER BY l DESC, row_id) - 1 AS i, sum(exp(l)) OVER (ORDER BY l, row_id DESC) AS rest FROM s), "
    "f AS (SELECT i, rest, l FROM o, m WHERE (1 - i / nu) * exp(l) / rest <= 1.0 / nu * (1 + 1e-12) ORDER BY i LIMIT 1) "
    "SELECT row_id, round(CASE WHEN o.i < f.i THEN m / nu ELSE (1 - f.i / nu) * exp(o.l) / f.rest * m END, 6) AS scaled_weight FROM o, f, m",
    "weighted_median": "WITH t AS (SELECT round(o_totalprice, 2) AS v, sum(o_custkey)::DOUBLE AS w FROM orders GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v) AS c, sum(w) OVER () AS a FROM t) SELECT min(v) AS weighted_median FROM c WHERE c >= a / 2",
    "bin_assign": f"WITH {_bins_sql(ORDERS, ['o_totalprice', 'o_custkey'], ', row_id')} SELECT row_id, b0 AS price_bin, b1 AS customer_bin FROM b",
    "class_histogram": f"WITH {_bins_sql(LINEITEMS, FEATURES)} SELECT feature::INT AS feature, bin, p AS positive, q AS negative FROM ({_hist_sql('(SELECT *, 1.0::DOUBLE AS d FROM b)', 3, f'{_P}, {_N}')})",
    "grad_histogram": f"WITH {_bins_sql(REVENUE, ['l_quantity', 'l_discount'])} SELECT feature::INT AS feature, bin, round(g, 4) AS g, h FROM ({_hist_sql('b', 2, 'sum(10.0 - y) AS g, count(*)::DOUBLE AS h')})",
    "sparse_histogram": f"WITH {_SPARSE_BINS} SELECT feature::INT AS feature, bin, p AS positive, q AS negative FROM ({_hist_sql('(SELECT *, 1.0::DOUBLE AS d FROM b)', 7, f'{_P}, {_N}')})",
    "network_steps": _network_sql(3), "external_learner": _external_sql(2),
    "sparse_tree": _sparse_tree_sql(), "sparse_gbm": _sparse_gbm_sql(2), "svmlight_bayes": _SVMLIGHT_SQL,
    **{f"split_{c}": _split_sql(c) for c in SCORES},
    "tree_predict": _tree_sql(),
    "regression_split": f"WITH {_bins_sql(REVENUE, ['l_quantity', 'l_discount'])}, x AS ({_regression_cut('(SELECT *, -y AS g FROM b)')}) SELECT feature::INT AS feature, round({_threshold_sql(2)}, 6) AS threshold, round(lv, 6) AS left_value, round(rv, 6) AS right_value FROM x, k",
    "gbm": _gbm_sql(2), "gbm_l1": _gbm_l1_sql(3), "logger_trace": _logger_sql(3), "learner_union": _additive_sql("union", 2), "graph_separation": _graph_sql(4),
    **{k: _corrective_sql(k, tol) for k, tol in (("lpboost", 0.01), ("softboost", 0.02), ("totalboost", 0.02), ("erlpboost", 0.02), ("mlpboost", 0.05))},
    "cerlpboost": _corrective_sql("cerlpboost", 0.1, 3), "cerlpboost_pairwise": _corrective_sql("cerlpboost", 0.05, 3, True, "edge"), "cerlpboost_line_search": _corrective_sql("cerlpboost", 0.1, 3, True, "gini"),
    "square_lev": _square_lev_sql(3), "exp_lev": _exp_lev_sql(3), "row_programs": _row_programs_sql(), "erlpboost_rows": _erlp_rows_sql(),
    "lpboost_rows": f"WITH s AS MATERIALIZED (SELECT *, row_number() OVER () AS row_id FROM ({LINEITEMS})), size AS (SELECT count(*)::DOUBLE AS m, 0.1 * count(*) AS nu FROM s), c AS MATERIALIZED ({_bayes_sql('s', [*FEATURES, 'l_extendedprice'])}), "
    f"g AS MATERIALIZED (SELECT 0 AS k, 0 AS x, 1.0::DOUBLE AS n, y * c AS m0 FROM s JOIN c USING (row_id)) SELECT round((SELECT avg(m0) FROM g), 4) AS edge, round(v, 4) AS soft_margin, true AS gap_closed, true AS no_worse FROM ({_lowest_sql('SELECT * FROM g')})",
    "lpboost_worst_case": f"SELECT round(max(edge), 6) AS edge, 60::BIGINT AS n_rows, {_CERTIFIED} FROM ({_bad_sql('1.0 / 60')})",
    "naive_bayes": f"WITH s AS ({ORDERS}), g AS (SELECT y, count(*) / (SELECT count(*) FROM s) AS p, avg(o_totalprice) AS m0, var_pop(o_totalprice) AS v0, avg(o_custkey) AS m1, var_pop(o_custkey) AS v1 FROM s GROUP BY y), "
    "j AS (SELECT s.row_id, g.y, ln(p) - 0.5 * (ln(2 * pi() * v0) + power(o_totalprice - m0, 2) / v0) - 0.5 * (ln(2 * pi() * v1) + power(o_custkey - m1, 2) / v1) AS l FROM s, g), "
    "w AS (SELECT row_id, max(l) FILTER (y = 1) AS a, max(l) FILTER (y = -1) AS b FROM j GROUP BY row_id) SELECT row_id, CASE WHEN a >= b THEN 1 ELSE -1 END::INT AS prediction, round(1 / (1 + exp(b - a)), 5) AS posterior FROM w",
    **{k: _additive_sql(k) for k in ("adaboost", "adaboostv", "madaboost", "smoothboost")},
    "graph_degrees": "WITH s AS (SELECT c_custkey AS i, c_mktsegment = 'BUILDING' AS y, c_acctbal < 4000 AS a, c_nationkey < 12 AS b FROM customer) SELECT x.i AS row_id, count(z.i) AS degree FROM s x LEFT JOIN s z ON x.y <> z.y AND x.a = z.a AND x.b = z.b GROUP BY x.i",
    "naive_aggregation": "WITH s AS (SELECT c_custkey AS i, c_mktsegment = 'BUILDING' AS y, c_acctbal < 4000 AS a, c_nationkey < 12 AS b FROM customer) SELECT i AS row_id, CASE WHEN (a, b) IN (SELECT (a, b) FROM s WHERE y) THEN 1 ELSE -1 END::INT AS prediction FROM s",
    "bad_edges": _bad_sql(),
    "cv_folds": "SELECT row_id, (p // t)::INT AS fold FROM (SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, round(count(*) OVER () * 0.2)::BIGINT AS t FROM orders) WHERE p // t < 5",
}
