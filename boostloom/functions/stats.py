"""Weighted aggregates: edges, margins, entropies, moments and medians.

Weights are Columns; functions that return DataFrames have one row, or one for each feature or label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostloom.sources.sample import TARGET, Sample, col


def margin(h: Column, y: Column | None = None) -> Column:
    return (F.col(TARGET) if y is None else y) * h


def edge(d: Column, h: Column, y: Column | None = None) -> Column:
    """Aggregate: sum of d y h."""
    return F.sum(d * margin(h, y))


def inner_product(a: Column, b: Column) -> Column:
    return F.sum(a * b)


def normalized(rows: DataFrame, weight: str) -> DataFrame:
    """Divide a column by the sum of its absolute values, which mustn't be 0."""
    total = rows.agg(F.sum(F.abs(weight))).first()[0]
    if not total:
        raise ValueError("the weights add up to 0")
    return rows.withColumn(weight, F.col(weight) / F.lit(total))


def entropy(d: Column) -> Column:
    """Aggregate: sum of d ln d, where 0 ln 0 is 0 (so this is minus Shannon's)."""
    return F.sum(F.when(d > 0, d * F.log(d)).otherwise(0.0))


def entropy_from_uniform(d: Column) -> Column:
    """Aggregate: Kullback-Leibler divergence from the uniform distribution over the rows."""
    return entropy(d) + F.log(F.count(F.lit(1)))


def label_weight(d: Column, label: float) -> Column:
    """Aggregate: the weight of a label."""
    return F.sum(F.when(F.col(TARGET) == label, d).otherwise(0.0))


def log_sum_exp(rows: DataFrame, exponent: Column) -> float:
    """ln of the sum of exp(exponent), shifted by its maximum."""
    top = rows.agg(F.max(exponent)).first()[0]
    return float(rows.agg((F.log(F.sum(F.exp(exponent - top))) + top)).first()[0])


def moments(sample: Sample, d: Column) -> DataFrame:
    """feature, mean, variance under a probability vector; the variance is taken about the mean (two passes)."""
    means = sample.df.agg(*[F.sum(d * col(f)).alias(f) for f in sample.features]).first()
    squares = sample.df.agg(*[F.sum(d * (col(f) - F.lit(means[f])) ** 2).alias(f) for f in sample.features])
    of = [F.struct(F.lit(f).alias("feature"), F.lit(float(means[f])).alias("mean"), col(f).alias("variance")) for f in sample.features]
    return squares.select(F.inline(F.array(*of)))


def label_moments(sample: Sample, d: Column) -> DataFrame:
    """y, weight, feature, mean, variance within each label; the divisor is at least 1e-100."""
    by = sample.df.withColumn("__d", d).groupBy(TARGET)
    means = by.agg(F.sum("__d").alias("__w"), *[(F.sum(F.col("__d") * col(f)) / F.greatest(F.sum("__d"), F.lit(1e-100))).alias(f"__m{i}") for i, f in enumerate(sample.features)])
    joined = sample.df.withColumn("__d", d).join(F.broadcast(means), TARGET)  # a row for each label
    second = joined.groupBy(TARGET).agg(
        F.first("__w").alias("weight"),
        *[F.struct(F.lit(f).alias("feature"), F.first(f"__m{i}").alias("mean"), (F.sum(F.col("__d") * (col(f) - F.col(f"__m{i}")) ** 2) / F.greatest(F.first("__w"), F.lit(1e-100))).alias("variance")).alias(f"__s{i}") for i, f in enumerate(sample.features)],
    )
    return second.select(TARGET, "weight", F.inline(F.array(*[f"__s{i}" for i in range(len(sample.features))])))


def _bracket(rows: DataFrame, goal: float, few: int = 10_000, bins: int = 512) -> tuple[float, float, list[tuple[float, float]]]:
    """Over (v, w): the weight under and the sum of v w under an interval that the goal's prefix ends in, and its sorted (v, w).

    A histogram narrows the interval until it holds few rows; each round is one aggregate.
    """
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    under = under_sum = 0.0
    while True:
        inside = rows.filter((F.col("v") >= low) & (F.col("v") <= high))
        if low == high:
            w = inside.agg(F.sum("w")).first()[0]
            return under, under_sum, [(low, w)]
        width = (high - low) / bins
        if not width or low + width == low:
            break
        cell = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
        table = sorted(inside.groupBy(cell.alias("c")).agg(F.sum("w").alias("w"), F.sum(F.col("v") * F.col("w")).alias("s"), F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect())
        for i, row in enumerate(table):
            if under + row["w"] >= goal or i == len(table) - 1:
                low, high, n = row["a"], row["b"], row["n"]
                break
            under, under_sum = under + row["w"], under_sum + row["s"]
        if n <= few:
            break
    left = rows.filter((F.col("v") >= low) & (F.col("v") <= high)).groupBy("v").agg(F.sum("w").alias("w"))
    return under, under_sum, sorted((r["v"], r["w"]) for r in left.collect())


def weighted_median(rows: DataFrame, value: Column, weight: Column) -> float:
    """The first value, ascending, at which the weights so far reach half of all."""
    table = rows.select(value.alias("v"), weight.alias("w")).filter("w > 0 and v is not null")
    total = table.agg(F.sum("w")).first()[0]
    if not total:
        return 0.0
    under, _, rest = _bracket(table, total / 2)
    for v, w in rest:
        under += w
        if under >= total / 2 * (1 - 1e-12):
            return float(v)
    return float(rest[-1][0])


def lower_tail_mean(rows: DataFrame, value: Column, number: Column, mass: float) -> float:
    """The mean of the `mass` least values, where each row stands for `number` of them.

    Values are cached while they are looked through: their expression is worked out once and not in every filter and sum.
    """
    table = rows.select(value.alias("v"), number.cast("double").alias("w")).persist()
    try:
        under, total, rest = _bracket(table, mass)
    finally:
        table.unpersist()
    for v, w in rest:
        take = min(w, mass - under)
        if take <= 0:
            break
        under, total = under + take, total + take * v
    return total / mass


def zero_one_loss(prediction: Column, y: Column | None = None) -> Column:
    """Aggregate: the share of rows with another label than predicted."""
    return F.avg(F.when(prediction != (F.col(TARGET) if y is None else y), 1.0).otherwise(0.0))
