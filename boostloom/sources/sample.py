"""Samples: a DataFrame of double features with a target column, and their readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boostloom.lineage import cut

TARGET, ROW = "y", "row_id"


def col(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col(f"`{name}`")


def with_row_id(rows: DataFrame, name: str = ROW) -> DataFrame:
    """Number rows from 0 in the order in which they are read; one row for each partition goes to the driver."""
    marked = rows.withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright("__m", 33)
    sizes = sorted((r["p"], r["n"]) for r in marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    starts = rows.sparkSession.createDataFrame(offsets or [(0, 0)], "__p long, __start long")
    joined = marked.join(F.broadcast(starts), part == F.col("__p"))
    return joined.withColumn(name, F.col("__start") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__start")


def places(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """Number rows from 0 by an order (ties by row_id).

    Rows are dealt out by ranges of the order and written; a range's rows are numbered within it, after the
    counts of the ranges before.  The driver sees one count for each range.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__k", order).repartitionByRange(n, "__k", ROW).withColumn("__b", F.spark_partition_id())
    dealt = cut(dealt)
    starts, total = [], 0
    for b, size in sorted((r["__b"], r["count"]) for r in dealt.groupBy("__b").count().collect()):
        starts.append((b, total))
        total += size
    table = spark.createDataFrame(starts or [(0, 0)], "__s int, __start long")
    within = F.row_number().over(Window.partitionBy("__b").orderBy(F.col("__k").asc_nulls_first(), ROW)) - 1
    numbered = dealt.withColumn("__w", within).join(F.broadcast(table), F.col("__b") == F.col("__s"))
    return numbered.withColumn(name, F.col("__start") + F.col("__w")).drop("__k", "__b", "__w", "__s", "__start")


class Sample:
    """Rows with `features` (double columns) and, once a target is set, a double column `y`.

    `row_id` is there if the rows have one; operators that depend on positions ask for it.
    """

    def __init__(self, df: DataFrame, features: list[str], has_target: bool = True):
        self.df, self.features, self.has_target = df, list(features), has_target
        self._shape: tuple[int, int] | None = None

    @staticmethod
    def from_df(df: DataFrame, features: list[str], target: str | Column | None = None, row_id: str | None = None, check: bool = True) -> Sample:
        """Take features and a target from any DataFrame; `check` refuses nulls with one aggregate."""
        columns = [col(f).cast("double").alias(f) for f in features]
        if target is not None:
            columns.append((col(target) if isinstance(target, str) else target).cast("double").alias(TARGET))
        if row_id is not None:
            columns.append(col(row_id).cast("long").alias(ROW))
        out = df.select(*columns)
        if check:
            nulls = out.agg(*[F.count_if(col(c).isNull()).alias(c) for c in out.columns]).first().asDict()
            if bad := sorted(c for c, n in nulls.items() if n):
                raise ValueError(f"null or non-numeric values in {', '.join(bad)}")
        return Sample(out, features, target is not None)

    @staticmethod
    def dummy(spark: SparkSession, n: int) -> Sample:
        """n rows: label +1 for the first half, -1 for the rest, and one feature that is 0 everywhere."""
        rows = spark.range(n).select(F.lit(0.0).alias("dummy"), F.when(F.col("id") < n // 2, 1.0).otherwise(-1.0).alias(TARGET), F.col("id").alias(ROW))
        return Sample(rows, ["dummy"])

    def with_df(self, df: DataFrame) -> Sample:
        return Sample(df, self.features, self.has_target)

    def set_target(self, name: str) -> Sample:
        """Make a feature the target."""
        if name not in self.features:
            raise KeyError(name)
        return Sample(self.df.withColumnRenamed(name, TARGET), [f for f in self.features if f != name])

    def target(self) -> DataFrame:
        return self.df.select(TARGET)

    def unique_target(self) -> list[float]:
        """The distinct target values, ascending."""
        return [r[0] for r in self.target().distinct().orderBy(TARGET).collect()]

    def shape(self) -> tuple[int, int]:
        """(rows, features)."""
        if self._shape is None:
            self._shape = (self.df.count(), len(self.features))
        return self._shape

    def replace_names(self, names: list[str]) -> tuple[Sample, list[str]]:
        """A sample with the features renamed, and the old names."""
        if len(names) != len(self.features):
            raise ValueError(f"{len(self.features)} names are needed, not {len(names)}")
        return Sample(self.df.withColumnsRenamed(dict(zip(self.features, names, strict=True))), list(names), self.has_target), self.features

    def __getitem__(self, name: str) -> Column:
        if name not in self.features:
            raise KeyError(name)
        return col(name)

    def at(self, i: int) -> tuple[list[float], float]:
        """(x, y) of the row with this id."""
        row = self.df.filter(F.col(ROW) == i).select(*[col(f) for f in self.features], TARGET).first()
        if row is None:
            raise IndexError(i)
        return [row[f] for f in self.features], row[TARGET]

    def check_binary(self) -> dict[str, float]:
        """One aggregate over the target; raises ValueError unless it takes two different whole values."""
        found = validation(self).first().asDict()
        if not found["n_rows"] or not self.features:
            raise ValueError("there must be at least one row and one feature")
        if found["n_fractional"] or found["n_labels"] != 2:
            raise ValueError(f"a binary target takes two whole values; this one takes {found['n_labels']}")
        return found

    def is_valid_binary_instance(self) -> bool:
        try:
            self.check_binary()
        except ValueError:
            return False
        return True

    def append(self, other: Sample) -> Sample:
        return self.with_df(self.df.unionByName(other.df))

    def feature_counts(self) -> DataFrame:
        """A row for each feature: n_rows, n_distinct, n_zero, min_value, max_value, in one pass."""
        of = lambda f: F.struct(F.lit(f).alias("feature"), F.count(col(f)).alias("n_rows"), F.countDistinct(col(f)).alias("n_distinct"), F.count_if(col(f) == 0).alias("n_zero"), F.min(col(f)).alias("min_value"), F.max(col(f)).alias("max_value"))
        return self.df.agg(F.array(*[of(f) for f in self.features]).alias("a")).select(F.inline("a"))

    def split(self, start: int, end: int, order: Column | None = None) -> tuple[Sample, Sample]:
        """(train, test): rows at places start..end-1 of the order are the test rows.

        The order is that of row_id by default, which is a place itself if ids run from 0 without gaps;
        other orders are numbered by places().
        """
        if order is None and self._contiguous():
            placed = self.df.withColumn("__place", F.col(ROW))
        else:
            placed = places(self.df, F.col(ROW) if order is None else order, "__place")
        inside = (F.col("__place") >= start) & (F.col("__place") < end)
        return self.with_df(placed.filter(~inside).drop("__place")), self.with_df(placed.filter(inside).drop("__place"))

    def _contiguous(self) -> bool:
        low, high, n = self.df.agg(F.min(ROW), F.max(ROW), F.countDistinct(ROW)).first()
        return n == self.shape()[0] and low == 0 and high == n - 1


def validation(sample: Sample) -> DataFrame:
    """n_rows, n_labels, min_label, max_label and n_fractional of the target, in one pass."""
    y = F.col(TARGET)
    return sample.df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(y).alias("n_labels"), F.min(y).alias("min_label"), F.max(y).alias("max_label"), F.count_if(y != F.floor(y)).alias("n_fractional")
    )


def read_csv(spark: SparkSession, path: str, has_header: bool = False) -> DataFrame:
    """All-double CSV with a row_id; a cell that isn't a number is an error.  Without a header columns are `Feat. [1]`, ..."""
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise ValueError(f"{path} is empty")
    first = [c.strip() for c in head[0][0].split(",")]
    names = first if has_header else [f"Feat. [{i + 1}]" for i in range(len(first))]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    rows = spark.read.schema(schema).csv(path, header=has_header, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    return with_row_id(rows)


def read_svmlight(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, y, features map<int, double>) of lines `y index:value ...`, with the indices as they stand."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    words = F.split(F.trim(F.regexp_replace("value", r"#.*", "")), r"\s+")
    pairs = F.transform(F.slice(words, 2, F.size(words) - 1), lambda w: F.split(w, ":"))
    entries = F.map_from_arrays(F.transform(pairs, lambda p: p[0].cast("int")), F.transform(pairs, lambda p: p[1].cast("double")))
    rows = lines.select(words[0].cast("double").alias(TARGET), F.when(F.size(words) > 1, entries).otherwise(F.create_map().cast("map<int,double>")).alias("features"))
    return with_row_id(rows).select(ROW, TARGET, "features")


def densify(rows: DataFrame) -> Sample:
    """Columns for the indices that occur (others are 0 everywhere); an entry that a row lacks is 0."""
    seen = sorted(r[0] for r in rows.select(F.explode(F.map_keys("features"))).distinct().collect())
    names = [f"Feat. [{i + 1}]" for i in seen]
    columns = [F.coalesce(F.col("features")[F.lit(i)], F.lit(0.0)).alias(n) for i, n in zip(seen, names, strict=True)]
    return Sample(rows.select(ROW, TARGET, *columns), names)


class SampleReader:
    """Builder: file(path), has_header(flag), target_feature(name), then read(spark)."""

    def __init__(self):
        self._path: str | None = None
        self._header, self._target = False, None

    def file(self, path: str) -> SampleReader:
        self._path = path
        return self

    def has_header(self, flag: bool) -> SampleReader:
        self._header = flag
        return self

    def target_feature(self, name: str) -> SampleReader:
        self._target = name
        return self

    def read(self, spark: SparkSession) -> Sample:
        """`.csv` is CSV, which needs a target; all else is SVMLight."""
        if not self._path:
            raise ValueError("no file was given")
        if not self._path.endswith(".csv"):
            return densify(read_svmlight(spark, self._path))
        if not self._target:
            raise ValueError("a CSV file needs a target feature")
        rows = read_csv(spark, self._path, self._header)
        return Sample(rows, [c for c in rows.columns if c != ROW], False).set_target(self._target)
