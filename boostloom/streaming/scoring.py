"""Hypotheses are Columns, so that a stream is scored by the plan that scores a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from boostloom.operators.base import Classifier, Regressor


def score_stream(rows: DataFrame, hypothesis: Classifier | Regressor, name: str = "prediction") -> DataFrame:
    """Add predictions to a streaming (or batch) DataFrame; no state is kept and no row is exchanged."""
    return rows.withColumn(name, hypothesis.predict())
