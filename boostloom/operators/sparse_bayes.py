"""Gaussian naive Bayes on sparse rows.

What an all-zero row's log density would be is one number for each label; an entry corrects it by its own term less that
of a zero.  Parameters are a table with a row for each feature, joined to the entries; no column is made for a feature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostloom.lineage import cut
from boostloom.operators.naive_bayes import LEAST_VARIANCE
from boostloom.operators.sparse import ENTRIES, FEW_FEATURES, with_feature
from boostloom.sources.sample import ROW, TARGET, Sample


class SparseGaussian:
    """Labels (ascending), logs of their priors and of an all-zero row's density, and (feature, mean, variance) arrays in the labels' order."""

    def __init__(self, labels: list[float], priors: list[float], features: DataFrame):
        self.labels, self.priors, self.features = labels, priors, features
        term = lambda k: -0.5 * (F.log(2 * math.pi * F.col("variance")[k]) + F.col("mean")[k] ** 2 / F.col("variance")[k])
        row = features.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(term(k)), F.lit(0.0)).alias(f"b{k}") for k in range(len(labels))]).first()
        self.few = row["n"] <= FEW_FEATURES
        self.zero = [math.log(p) + row[f"b{k}"] for k, p in enumerate(priors)]

    def log_joint(self, rows: DataFrame) -> DataFrame:
        """The rows with `log_joint`, an array of ln of prior times density in the labels' order; rows need a row_id.

        Features that training rows lack don't count, nor do null values.
        """
        entries = rows.select(ROW, F.explode(ENTRIES).alias("feature", "value")).filter("value is not null and value <> 0")
        met = with_feature(entries, self.features, self.few)
        apart = lambda k: -0.5 * ((F.col("value") - F.col("mean")[k]) ** 2 - F.col("mean")[k] ** 2) / F.col("variance")[k]
        sums = met.groupBy(F.col(ROW).alias("__row")).agg(*[F.sum(apart(k)).alias(f"__c{k}") for k in range(len(self.labels))])
        joined = rows.join(sums, F.col(ROW) == F.col("__row"), "left")
        logs = F.array(*[F.lit(z) + F.coalesce(F.col(f"__c{k}"), F.lit(0.0)) for k, z in enumerate(self.zero)])
        return joined.withColumn("log_joint", logs).drop("__row", *[f"__c{k}" for k in range(len(self.labels))])

    def _of(self) -> Column:
        """The position of the largest; ties go to the larger label, as in the dense classifier."""
        return F.size("log_joint") - F.array_position(F.reverse(F.col("log_joint")), F.array_max("log_joint")).cast("int")

    def predict_all(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        """The rows with the label of the largest posterior."""
        return self.log_joint(rows).withColumn(name, F.array(*[F.lit(x) for x in self.labels])[self._of()]).drop("log_joint")

    def posterior(self, rows: DataFrame, label: float, name: str = "posterior") -> DataFrame:
        """The rows with the probability of a label."""
        at = self.labels.index(label)
        total = F.aggregate("log_joint", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("log_joint")[at]))
        return self.log_joint(rows).withColumn(name, 1.0 / total).drop("log_joint")


class SparseGaussianNB:
    """Fits means and variances of all features that have an entry other than 0, zeros included, by label.

    Two aggregates over the entries (means, then squares about them) and one over the labels; weights are a Column.  The result
    is the same as GaussianNB's on dense columns of the same features.
    """

    def fit(self, sample: Sample, weight: Column | None = None) -> SparseGaussian:
        rows = sample.df.withColumn("__w", F.lit(1.0) if weight is None else weight).filter("__w > 0")
        mass = {r[0]: r[1] for r in rows.groupBy(TARGET).agg(F.sum("__w")).orderBy(TARGET).collect()}  # a row for each label
        if not mass:
            raise ValueError("no row has a positive weight")
        labels, total = sorted(mass), sum(mass.values())
        entries = rows.select(TARGET, "__w", F.explode(ENTRIES).alias("feature", "value")).filter("value is not null and value <> 0")
        of = lambda k, x: F.sum(F.when(F.col(TARGET) == labels[k], x).otherwise(0.0))
        means = entries.groupBy("feature").agg(F.array(*[of(k, F.col("__w") * F.col("value")) / mass[x] for k, x in enumerate(labels)]).alias("mean"))
        means = cut(means)
        few = means.count() <= FEW_FEATURES
        place = F.array_position(F.array(*[F.lit(float(x)) for x in labels]), F.col(TARGET)).cast("int")
        apart = with_feature(entries, means, few).withColumn("__d", F.col("__w") * (F.col("value") - F.get("mean", place - 1)) ** 2)
        lacking = lambda k: (F.lit(mass[labels[k]]) - of(k, F.col("__w"))) * F.first("mean")[k] ** 2
        spread = apart.groupBy("feature").agg(
            F.first("mean").alias("mean"),
            F.array(*[F.greatest((of(k, F.col("__d")) + lacking(k)) / mass[x], F.lit(LEAST_VARIANCE)) for k, x in enumerate(labels)]).alias("variance"),
        )
        return SparseGaussian(labels, [mass[x] / total for x in labels], cut(spread))
