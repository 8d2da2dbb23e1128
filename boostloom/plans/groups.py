"""Groups of rows with equal label and margins: all that programs over margins need to know of the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from boostloom.operators.base import Classifier, Prepared
from boostloom.lineage import cut
from boostloom.sources.sample import TARGET


class TooManyGroups(ValueError):
    """Margins take too many values for a driver."""


class MarginGroups:
    """Keeps a group key by row, and the groups' margins and sizes on the driver.

    The number of groups is that of different margin vectors, however many rows there are; over
    `most` of them TooManyGroups is raised and the state is as before.
    """

    def __init__(self, train: Prepared, most: int = 100_000, every: int = 8):
        self.train, self.most, self.every = train, most, every
        train.df = train.df.withColumn("__g", F.xxhash64(TARGET))
        self.hypotheses: list[Classifier] = []
        first = train.df.groupBy("__g").agg(F.sum("n").alias("n")).collect()
        self.keys = np.array([r["__g"] for r in first], np.int64)
        self.number = np.array([r["n"] for r in first], float)
        self.margins = np.zeros((len(first), 0))

    def add(self, h: Classifier) -> np.ndarray:
        """Split the groups by the margins of one more hypothesis, and return these."""
        margin = F.col(TARGET) * h.confidence(self.train.binned)
        old = self.train.df
        rows = old.withColumn("__m", margin).withColumn("__next", F.xxhash64("__g", "__m"))
        found = rows.groupBy("__g", "__next").agg(F.sum("n").alias("n"), F.first("__m").alias("m")).limit(self.most + 1).collect()
        if len(found) > self.most:
            raise TooManyGroups(f"over {self.most} groups of equal margins")
        place = {k: i for i, k in enumerate(self.keys.tolist())}
        parent = np.array([place[r["__g"]] for r in found])
        new = np.array([r["m"] for r in found], float)
        self.margins = np.column_stack([self.margins[parent], new])
        self.keys, self.number = np.array([r["__next"] for r in found], np.int64), np.array([r["n"] for r in found], float)
        self.train.df = rows.drop("__m", "__g").withColumnRenamed("__next", "__g")
        self.hypotheses.append(h)
        if len(self.hypotheses) % self.every == 0:
            self.train.df = cut(self.train.df)
            old.unpersist()
        return new

    def weight(self, d: np.ndarray) -> Column:
        """Each row's weight as a column: adds it to the table by group key."""
        spark = self.train.df.sparkSession
        table = spark.createDataFrame(list(zip(self.keys.tolist(), d.tolist(), strict=True)), "__k long, __d double")
        self.train.df = self.train.df.drop("__d").join(F.broadcast(table), F.col("__g") == F.col("__k"), "left").drop("__k")  # `most` rows at most
        return F.coalesce("__d", F.lit(0.0))

    def release(self) -> None:
        """Drop what groups have added to the rows."""
        self.train.df = self.train.df.drop("__g", "__d")
