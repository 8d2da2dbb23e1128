"""Weighted draws that leave rows where they are."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boostloom.operators.base import Prepared, mass
from boostloom.sources.sample import ROW, TARGET, col

SHARE = "__share"
_DIGITS = 13


def uniform(key: list[Column], seed: int, draw: int) -> Column:
    """A number in (0, 1) by the key, the seed and the draw; the same however rows are partitioned."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key], F.lit(str(seed)), F.lit(str(draw))))
    return (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


@dataclass
class Weighted:
    """Rows of a prepared sample with positive weights: `rows` have the features, y and __w; `total` is the sum of weights."""

    rows: DataFrame
    features: list[str]
    total: float
    count: int
    key: list[Column]

    @property
    def names(self) -> list[str]:
        """By place, since grouped pandas functions don't take every name that a column may have."""
        return [f"__x{i}" for i in range(len(self.features))]

    @staticmethod
    def of(train: Prepared, weight: Column, features: list[str]) -> Weighted:
        keyed = ROW in train.df.columns
        w = mass(weight)
        rows = train.df.select(*[col(f) for f in features], TARGET, *[ROW] * keyed, w.alias("__w")).filter("__w > 0")
        count, total = rows.agg(F.count(F.lit(1)), F.sum("__w")).first()
        if not count:
            raise ValueError("no row has a positive weight")
        return Weighted(rows, features, float(total), count, [F.col(ROW)] if keyed else [*[col(f) for f in features], F.col(TARGET)])

    def draw(self, size: int, seed: int, number: int) -> DataFrame:
        """Features (named as `names` says), y and __share of about `size` rows, each taken with a probability p of size * weight / total (1 at most).

        A row's share is weight / (total * p), so that sums of shares times values are unbiased for the weighted mean.
        With `size` of at least the number of rows all are taken and the sum is the mean itself.
        Rows are drawn independently: the number of them is `size` at most on average, and 10 roots of it more with
        odds under 1e-20.  Without row_ids rows that are equal are taken or left together, which is unbiased too.
        """
        p = F.lit(1.0) if size >= self.count else F.least(F.lit(1.0), F.col("__w") * F.lit(size / self.total))
        taken = self.rows if size >= self.count else self.rows.filter(uniform(self.key, seed, number) < p)
        return taken.select(*[col(f).alias(n) for f, n in zip(self.features, self.names, strict=True)], TARGET, (F.col("__w") / (F.lit(self.total) * p)).alias(SHARE))
