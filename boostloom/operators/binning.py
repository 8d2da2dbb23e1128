"""Equal-width bins: features become bin numbers once, and rows of equal bins and label become one."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from boostloom.operators.base import Prepared
from boostloom.sources.sample import TARGET, Sample, col

#: Half the width that a constant column is given.
EPSILON = 1e-3
MOST_BINS = 255


@dataclass
class Bins:
    """`n` bins of equal width from `low`; the outer ones are open."""

    low: float
    width: float
    n: int

    @staticmethod
    def cut(low: float, high: float, n: int) -> Bins:
        if low == high:
            low, high = low - EPSILON, high + EPSILON
        return Bins(low, (high - low) / n, n)

    def index(self, x: Column) -> Column:
        cell = F.floor((x - F.lit(self.low)) / F.lit(self.width))
        return F.greatest(F.least(cell, F.lit(self.n - 1)), F.lit(0)).cast("int")

    def threshold(self, left: int, right: int) -> float:
        """The middle of the gap between two occupied bins."""
        return (self.low + self.width * (left + 1) + self.low + self.width * right) / 2

    def __str__(self) -> str:
        edges = [f"{self.low + self.width * i:.4g}" for i in range(1, self.n)]
        ends = ["-inf", *edges, "+inf"]
        return " ".join(f"[{a}, {b})" for a, b in zip(ends, ends[1:], strict=False))


def bin_column(feature: str) -> str:
    """The name of a feature's bin column: letters, digits and underscores only."""
    return "__bin_" + re.sub(r"[^0-9A-Za-z]", lambda c: "_" if c[0] == "_" else f"_{ord(c[0]):x}_", feature)


def make_bins(sample: Sample, n_bins: dict[str, int]) -> tuple[dict[str, Bins], int]:
    """Bins of every feature and the number of rows, from one aggregate.

    A feature has min(distinct values, 255) bins unless `n_bins` says otherwise.
    """
    columns = [F.count(F.lit(1)).alias("m")]
    for i, f in enumerate(sample.features):
        columns += [F.min(col(f)).alias(f"a{i}"), F.max(col(f)).alias(f"b{i}"), F.approx_count_distinct(col(f), 0.02).alias(f"d{i}")]
    found = sample.df.agg(*columns).first().asDict()
    if not found["m"]:
        raise ValueError("the sample has no rows")
    # exact numbers only where they may matter
    unsure = [f for i, f in enumerate(sample.features) if f not in n_bins and found[f"d{i}"] < 2 * MOST_BINS]
    exact = sample.df.agg(*[F.size(F.collect_set(col(f))).alias(f) for f in unsure]).first().asDict() if unsure else {}
    return {f: Bins.cut(found[f"a{i}"], found[f"b{i}"], n_bins.get(f) or min(exact.get(f, MOST_BINS), MOST_BINS)) for i, f in enumerate(sample.features)}, found["m"]


def prepare(sample: Sample, n_bins: dict[str, int], keep_rows: bool) -> Prepared:
    """Bin columns, y and n; equal rows are put together where that leaves under a quarter of them."""
    bins, m = make_bins(sample, n_bins)
    columns = [b.index(col(f)).alias(bin_column(f)) for f, b in bins.items()]
    names = [bin_column(f) for f in bins]
    rows = sample.df.select(*columns, TARGET, *[col(c) for c in sample.df.columns if keep_rows and c != TARGET])
    if not keep_rows:
        cells = rows.agg(F.approx_count_distinct(F.xxhash64(*names, TARGET), 0.05)).first()[0]
        if cells < m / 4:
            df = rows.groupBy(*names, TARGET).agg(F.count(F.lit(1)).alias("n"))
            if cells < 100_000:
                df = df.coalesce(max(1, cells // 20_000))
            return Prepared(df.persist(), m, True, {"bins": bins})
    return Prepared(rows.withColumn("n", F.lit(1)).persist(), m, True, {"bins": bins})
