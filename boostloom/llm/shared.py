"""Tables in the shared folder, and connected components over them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where it is unset, a temporary one serves if driver and executors are one process; on a cluster this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/boostloom-checkpoints"
    return f"{base.rstrip('/')}/boostloom/{spark.sparkContext.applicationId}"


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: later plans start there, whatever executors are lost.

    What the write has shuffled is dropped when it has ended, as nothing reads it again.
    """
    spark = rows.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    with _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    out.written_at = path
    return out


def discard(rows: DataFrame) -> None:
    """Delete a table that written() has written and that no plan reads any more."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(rows.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most so many rows for what is written meanwhile; rows that hold whole texts' shingles can be large."""
    with _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node that it reaches.

    Labels are lowered along links and then replaced by their own labels, which halves the way to the
    smallest, until nothing changes; each round is written to the shared folder.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lowered = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        of = labels.select(F.col("node").alias("c_node"), F.col("component").alias("c_component"))
        jumped = lowered.join(of, F.col("component") == F.col("c_node")).select("node", "old", F.least("component", "c_component").alias("component"))
        after = written(jumped)
        labels = after.select("node", "component")
        if after.filter("old <> component").limit(1).count() == 0:
            return labels
