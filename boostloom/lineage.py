"""Cutting the lineage of tables that loops build up."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Where the folder is unset, a temporary one serves if driver and executors are one process; on a
    cluster this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/boostloom-checkpoints"
    return f"{base.rstrip('/')}/boostloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder (see place()) and read again.

    The copy is in the shared folder, so that it outlives executors; it is cached for the rounds to come.
    """
    path = place(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).persist()
